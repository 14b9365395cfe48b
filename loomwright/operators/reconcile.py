"""A dictionary held against what was observed: types, nulls, keys, cardinality, use, personal data, ranges and staleness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.register import bare
from loomwright.operators.rules import PATTERNS

# Declared types and the kinds that they stand for, flags, limits.
TYPES = {
    "int": ["int"], "integer": ["int"], "bigint": ["int"], "smallint": ["int"], "float": ["float"], "double": ["float"], "decimal": ["float"], "numeric": ["float", "int"], "number": ["float", "int"],
    "string": ["string", "object"], "varchar": ["string", "object"], "text": ["string", "object"], "char": ["string", "object"], "boolean": ["bool"], "bool": ["bool"], "date": ["datetime"], "datetime": ["datetime"], "timestamp": ["datetime"],
}
NOT_NULL, PRIMARY, RETIRED, NO = ["N", "NO", "FALSE", "NOT NULL"], ["PK", "PRIMARY", "PRIMARY KEY"], ["deprecated", "unused", "archived"], ["N", "NO", "FALSE"]
DRIFT, STALE_DAYS, SEPARATORS = 0.10, 90, ["-", "..", ","]
SHAPE = "field string, declared string, observed string, severity string, status string"


def finding(test: Column, field: str, declared: Column, observed: Column, severity: str = "warning", status: str = "confirmed") -> Column:
    """A struct of SHAPE where the test holds, else null."""
    values = (F.lit(field), declared, observed, F.lit(severity), F.lit(status))
    return F.when(test, F.struct(*[v.cast("string").alias(c.split()[0]) for v, c in zip(values, SHAPE.split(", "), strict=True)]))


def range_reversed(text: Column) -> Column:
    """True for a range of two numbers, split at the first separator that it has, whose first is the larger one."""
    found = F.lit(False)
    for mark in reversed(SEPARATORS):
        at = F.locate(mark, text)
        low, high = F.substr(text, F.lit(1), at - 1), F.substr(text, at + len(mark))
        number = lambda part: bare(part).try_cast("double")
        found = F.when(at > 0, F.coalesce(number(low) > number(high), F.lit(False))).otherwise(found)
    return found


def days_since(text: Column, now: Column) -> Column:
    """Whole days from an ISO time with an offset to now; null for anything else."""
    plain = bare(text)
    when = F.when(plain.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), plain.try_cast("timestamp"))
    return F.floor((F.unix_micros(now) - F.unix_micros(when)) / 86_400_000_000)


def reconciled(profile: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """(table_name, column_name, SHAPE): the findings of every table of the profile.

    entries (table_name, position, column_name, and the attributes read here). Names meet without case; of entries of one
    name the last counts. A table without entries has one finding that nothing could be verified; entries of columns that
    the table lacks are checked for their own range and age alone.
    """
    named = entries.where("column_name <> ''").withColumn("__name", F.lower("column_name"))
    last = named.groupBy("table_name", "__name").agg(F.max_by(F.struct(*[F.col(c) for c in entries.columns]), "position").alias("e"))
    met = profile.withColumn("__name", F.lower("column_name")).join(last, ["table_name", "__name"])
    e = lambda name: F.col(f"e.{name}")
    upper, lower = (lambda name: F.upper(bare(e(name)))), (lambda name: F.lower(bare(e(name))))
    fits = reduce(lambda x, kv: x.when(lower("data_type_declared") == kv[0], F.col("dtype").isin(kv[1])), TYPES.items(), F.when(F.lit(False), F.lit(True)))
    unique, rows, declared = F.col("unique_count"), F.col("row_count"), bare(e("cardinality_declared")).try_cast("bigint")
    personal = F.col("column_name").rlike(PATTERNS["pii"])
    nulls = F.format_string("%d nulls (%.1f%%)", "null_count", "null_pct")
    checks = [
        finding(~fits, "data_type", e("data_type_declared"), F.col("dtype")),
        finding(upper("nullable_declared").isin(NOT_NULL) & (F.col("null_count") > 0), "nullable", F.lit("NOT NULL"), nulls),
        finding(upper("primary_foreign_key").isin(PRIMARY) & (unique < rows) & (rows > 0), "primary_key", F.lit("PK"), F.format_string("%d/%d unique", unique, rows)),
        finding((declared > 0) & (unique > 0) & (F.abs(unique - declared) / F.when(declared > 0, declared) > DRIFT), "cardinality", declared, unique),
        finding((F.col("null_pct") >= 100) & (e("field_role") != "") & ~lower("field_role").isin(RETIRED), "field_role", e("field_role"), F.lit("100% null")),
        finding(upper("pii_flag").isin(NO) & personal, "pii_flag", F.lit("No PII"), F.lit("name suggests personal data")),
        finding(upper("pii_flag").isin(NO) & ~personal, "pii_flag_values", F.lit("No PII"), F.lit("values not checked"), "info", "could_not_verify"),
    ]
    observed = met.select("table_name", "column_name", F.inline(F.filter(F.array(*checks), lambda c: c.isNotNull())))
    age = days_since(F.col("last_synced_at"), now)
    own = [
        finding(range_reversed(bare(F.col("valid_values_range"))), "valid_values_range", bare(F.col("valid_values_range")), F.lit("(internal check)")),
        finding(age > STALE_DAYS, "last_synced_at", F.col("last_synced_at"), F.concat(age.cast("string"), F.lit(" days old"))),
    ]
    internal = named.select("table_name", "column_name", F.inline(F.filter(F.array(*own), lambda c: c.isNotNull())))
    bare_tables = profile.select("table_name").distinct().join(entries.select("table_name"), "table_name", "left_anti")
    nothing = finding(F.lit(True), "reconciliation", F.lit("(no metadata uploaded)"), F.lit("(profile only)"), "info", "could_not_verify")
    silent = bare_tables.select("table_name", F.lit("*").alias("column_name"), F.inline(F.array(nothing)))
    return observed.unionByName(internal).unionByName(silent)
