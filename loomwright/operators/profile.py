"""Column and table profiles: one aggregation over a table, whatever its number of columns.

Only the profile leaves the executors, never rows. Exact distinct counts are the costly part at scale: `approximate`
replaces them by HyperLogLog++ sketches, which keep the aggregation to one shuffle of one row for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.lineage import held
from loomwright.operators.selection import exact_percentiles
from pyspark.sql import types as T

# Fixed values of the profiler.
SURROGATE_NUMBERS = [-1, -999, 999, 9999]
SURROGATE_TOKENS = ["-1", "999", "9999", "-999", "n/a", "na", "none", "null", "unknown", "unk", ".", "?", "missing", ""]
EMAIL_VALUE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SSN_VALUE = r"^\d{3}-\d{2}-\d{4}$"
NAME_TOKEN = r"^[A-Za-z][A-Za-z'\-]{1,29}$"
ORG_WORDS = [
    "association", "center", "centre", "clinic", "company", "corp", "corporation", "foundation", "group", "health", "hospital", "inc",
    "institute", "llc", "ltd", "network", "org", "pharma", "services", "system", "systems", "team", "university",
]
QUARTILES = [0.25, 0.5, 0.75]
DATE_HINTS = ["date", "time", "_at", "_on", "_dt", "_ts", "timestamp"]

SCHEMA = (
    "ordinal int, column_name string, dtype string, row_count long, null_count long, null_pct double, unique_count long, mean double, std double, "
    "min_value double, max_value double, q25 double, q50 double, q75 double, skew double, kurtosis double, earliest timestamp, latest timestamp, "
    "days_since_latest long, surrogate_null_count long, infinite_count long"
)


def dtype_of(kind: T.DataType) -> str:
    """int, float, string, bool, datetime or object."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return {"boolean": "bool", "string": "string"}.get(kind.typeName(), "object")


def present(name: str, dtype: str) -> Column:
    """The value, with NaN as null."""
    value = F.col(f"`{name}`")
    return F.when(~F.isnan(value), value) if dtype == "float" else value


def corrected_skew(n: Column, g1: Column) -> Column:
    """Sample skewness from the population's."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(n: Column, g2: Column) -> Column:
    """Sample excess kurtosis from the population's."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def value_key(name: str, dtype: str) -> Column:
    """A text for each value of a column, the same for equal values; long ones are hashed. Null and NaN are null."""
    v = present(name, dtype)
    if dtype == "datetime":
        return F.unix_micros(v.cast("timestamp")).cast("string")
    if dtype == "object":
        return F.when(v.isNotNull(), F.sha2(F.to_json(F.struct(v)), 256))
    text = (v + F.lit(0)).cast("string") if dtype == "float" else v.cast("string")  # one zero, whatever its sign
    return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text) if dtype == "string" else text


def values_of(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, v): every value of the columns, by its key."""
    kinds = {f.name: dtype_of(f.dataType) for f in df.schema}
    every = F.array(*[F.struct(F.lit(c).alias("column_name"), value_key(c, kinds[c]).alias("v")) for c in columns or df.columns])
    return df.select(F.inline(every)).where("v is not null")


def of_tables(tables: Mapping[str, DataFrame], part: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """part of every table, with its table_name first: one plan whose later steps serve all tables."""
    return reduce(DataFrame.union, [part(df).select(F.lit(t).alias("table_name"), "*") for t, df in tables.items()])


def counted_values(values: DataFrame, *key: str) -> DataFrame:
    """(*key, unique_count, top_count, filled) of values (*key, v).

    Rows are counted where they are read before values are shuffled, so a frequent value is a row for each task.
    """
    counts = values.groupBy(*key, "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*key).agg(F.count(F.lit(1)).alias("unique_count"), F.max("n").alias("top_count"), F.sum("n").alias("filled"))


def value_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, unique_count, top_count, filled) of columns with values: all columns' values counted in one pass."""
    return counted_values(values_of(df, columns), "column_name")


def table_profiles(tables: Mapping[str, DataFrame], ref: Column | None = None, only: set[str] | None = None) -> DataFrame:
    """The profiles of several tables, with table_name last; the values of all of them are counted in one pass."""
    parts = (only if only is not None else {"distinct", "moments", "quartiles", "surrogates", "ranges"}) - {"distinct"}
    found = of_tables(tables, lambda df: column_profile(df, ref, only=parts))
    names = [c for c in found.columns if c != "table_name"]
    if only is not None and "distinct" not in only:
        return found.select(*names, "table_name")
    exact = counted_values(of_tables(tables, values_of), "table_name", "column_name").select("table_name", "column_name", F.col("unique_count").alias("__unique"))
    joined = found.join(exact, ["table_name", "column_name"], "left")
    return joined.select(*[F.coalesce("__unique", F.lit(0)).alias(c) if c == "unique_count" else F.col(c) for c in names], "table_name")


def first_values(df: DataFrame, columns: list[str], order: list[str], count: int) -> DataFrame:
    """(column_name, position, value): the first non-null values of each column in the given order, from one scan.

    Each task keeps its own first values of a column before they are shuffled.
    """
    place = F.struct(*[F.col(f"`{c}`") for c in order]).alias("__order")
    every = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    long = df.select(place, F.inline(every)).where("value is not null")
    number = F.row_number().over(Window.partitionBy("column_name").orderBy(*[F.col("__order")[c] for c in order]))
    return long.withColumn("position", number).where(F.col("position") <= count).select("column_name", "position", "value")


def with_quartiles(found: DataFrame, df: DataFrame) -> DataFrame:
    """The profile with the exact quartiles of numeric columns: two passes over their values, no sort."""
    kinds = {f.name: dtype_of(f.dataType) for f in df.schema}
    numbers = [F.struct(F.lit(c).alias("column_name"), present(c, k).cast("double").alias("x")) for c, k in kinds.items() if k in ("int", "float")]
    if not numbers:
        return found
    each = exact_percentiles(df.select(F.inline(F.array(*numbers))), ["column_name"], "x", QUARTILES)
    wide = each.groupBy("column_name").agg(*[F.max(F.when(F.col("probability") == q, F.col("x"))).alias(f"__{n}") for n, q in zip(("q25", "q50", "q75"), QUARTILES, strict=True)])
    return found.join(wide, "column_name", "left").select(*[F.col(f"__{c}").alias(c) if c in ("q25", "q50", "q75") else F.col(c) for c in found.columns])


def row_keys(df: DataFrame) -> DataFrame:
    """(row): a 256-bit hash of each row; nulls are equal."""
    return df.select(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256).alias("row"))


def column_profile(df: DataFrame, ref: Column | None = None, approximate: bool = False, only: set[str] | None = None) -> DataFrame:
    """One row for each column (SCHEMA). ref: the time that freshness is measured at; the session's now if None.

    only: of distinct, moments, quartiles, surrogates and ranges, those to compute; the others' columns are null or 0.
    """
    want = lambda part: only is None or part in only
    ref = F.current_timestamp() if ref is None else ref
    kinds = {f.name: dtype_of(f.dataType) for f in df.schema}
    aggregates, rows = [F.count(F.lit(1)).alias("n")], []
    null = lambda kind: F.lit(None).cast(kind)
    for k, (name, dtype) in enumerate(kinds.items()):
        v, at = present(name, dtype), f"c{k}_"
        key = v if dtype != "object" else F.to_json(F.struct(v))
        aggregates.append(F.count(v).alias(at + "n"))
        if want("distinct") and approximate:
            aggregates.append(F.approx_count_distinct(key).alias(at + "u"))
        numeric, dated = dtype in ("int", "float"), dtype == "datetime" and want("ranges")
        moments, quarters, marked = numeric and want("moments"), numeric and want("quartiles"), (numeric or dtype == "string") and want("surrogates")
        if numeric:
            x = v.cast("double")
            finite = F.when(F.abs(x) < float("inf"), x)
            if moments:
                aggregates += [f(x).alias(at + s) for s, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max), ("g1", F.skewness), ("g2", F.kurtosis))]
            if moments:
                aggregates.append((F.count(x) - F.count(finite)).alias(at + "i"))
            if quarters and approximate:
                aggregates.append(F.percentile_approx(x, QUARTILES, 10000).alias(at + "q"))
            if marked:
                aggregates.append(F.count_if(v.isin(SURROGATE_NUMBERS)).alias(at + "s"))
        elif dated:
            aggregates += [F.min(v.cast("timestamp")).alias(at + "min"), F.max(v.cast("timestamp")).alias(at + "max")]
        elif marked:
            aggregates.append(F.count_if(F.lower(F.trim(v)).isin(SURROGATE_TOKENS)).alias(at + "s"))
        n = F.col(at + "n")
        stat = lambda s, at=at, on=moments: F.col(at + s) if on else null("double")
        age = F.greatest(F.lit(0).cast("long"), F.floor((F.unix_timestamp(ref) - F.unix_timestamp(at + "max")) / 86400)) if dated else null("long")
        rows.append(F.struct(
            F.lit(k).alias("ordinal"), F.lit(name).alias("column_name"), F.lit(dtype).alias("dtype"), F.col("n").alias("row_count"), (F.col("n") - n).alias("null_count"),
            F.when(F.col("n") > 0, F.round((F.col("n") - n) * 100.0 / F.col("n"), 2)).otherwise(0.0).alias("null_pct"), (F.col(at + "u") if want("distinct") and approximate else null("long")).alias("unique_count"),
            stat("mean").alias("mean"), (F.when(n == 1, 0.0).otherwise(F.col(at + "std")) if moments else null("double")).alias("std"), stat("min").alias("min_value"), stat("max").alias("max_value"),
            *[(F.col(at + "q")[i].cast("double") if quarters and approximate else null("double")).alias(q) for i, q in enumerate(("q25", "q50", "q75"))],
            (corrected_skew(n, F.col(at + "g1")) if moments else null("double")).alias("skew"), (corrected_kurtosis(n, F.col(at + "g2")) if moments else null("double")).alias("kurtosis"),
            (F.col(at + "min") if dated else null("timestamp")).alias("earliest"), (F.col(at + "max") if dated else null("timestamp")).alias("latest"), age.alias("days_since_latest"),
            (F.col(at + "s") if marked else F.lit(0).cast("long")).alias("surrogate_null_count"), (F.col(at + "i") if moments else F.lit(0).cast("long")).alias("infinite_count"),
        ))
    found = df.agg(*aggregates).select(F.inline(F.array(*rows)))
    if want("quartiles") and not approximate:
        found = with_quartiles(found, df)
    if not want("distinct") or approximate:
        return found
    exact = value_stats(df).select("column_name", F.col("unique_count").alias("__unique"))
    return found.join(exact, "column_name", "left").select(*[F.coalesce("__unique", F.lit(0)).alias(c) if c == "unique_count" else F.col(c) for c in found.columns])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """dup_rows: rows beyond the first of each; nulls are equal. Rows are grouped by a 256-bit hash: a shuffle of hashes."""
    return row_keys(df).groupBy("row").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("dup_rows"))


def table_summary(profile: DataFrame) -> DataFrame:
    """row_count, column_count, missing_pct of a column profile."""
    return profile.agg(F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"), F.round(F.avg(F.col("null_count") / F.greatest("row_count", F.lit(1))) * 100, 2).alias("missing_pct"))


def sample_values(df: DataFrame, order: list[str], count: int = 5, length: int = 40) -> DataFrame:
    """(column_name, position, sample): the first non-null values of each column in the given order, long ones cut."""
    cut = F.when(F.length("value") > length, F.concat(F.substring("value", 1, length - 1), F.lit("…"))).otherwise(F.col("value"))
    return first_values(df, df.columns, order, count).select("column_name", "position", cut.alias("sample"))


def person_name(text: Column) -> Column:
    """True for 2 to 4 name-like words, none of them an organisation's."""
    plain = F.trim(F.regexp_replace(F.translate(text, ",", " "), r"\s+", " "))
    tokens = F.transform(F.split(plain, " "), lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))
    fits = F.forall(tokens, lambda t: t.rlike(NAME_TOKEN)) & ~F.exists(tokens, lambda t: F.lower(t).isin(ORG_WORDS))
    return (plain != "") & (F.length(plain) <= 80) & ~plain.contains("@") & ~plain.rlike(r"\d") & F.size(tokens).between(2, 4) & fits


def value_patterns(df: DataFrame, column: str, order: list[str], scan: int = 100) -> DataFrame:
    """scanned, email, ssn, person_name among the first non-null values; a value counts for one pattern at most."""
    text = F.trim(F.col(column).cast("string"))
    some = df.where(F.col(column).isNotNull()).orderBy(*order).limit(scan).select(text.alias("v")).where("v <> ''")
    kind = F.when(F.col("v").rlike(EMAIL_VALUE), "email").when(F.col("v").rlike(SSN_VALUE), "ssn").when(person_name(F.col("v")), "person_name")
    return some.withColumn("k", kind).agg(F.count(F.lit(1)).alias("scanned"), *[F.count_if(F.col("k") == k).alias(k) for k in ("email", "ssn", "person_name")])


def correlated_pairs(df: DataFrame, threshold: float = 0.95, least_rows: int = 20) -> DataFrame:
    """(column_a, column_b, r) of numeric pairs with |Pearson r| at least the threshold: one aggregation for all pairs."""
    names = [f.name for f in df.schema if dtype_of(f.dataType) in ("int", "float")]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(F.corr(a, b), 4).alias("r")) for a, b in pairs]
    if not rows:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.array(*rows).alias("all")).where(F.col("n") >= least_rows).select(F.inline("all")).where(F.abs("r") >= threshold)


def top_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, top_share): the share of the most frequent among the non-null values of each column."""
    return value_stats(df, columns).select("column_name", (F.col("top_count") / F.col("filled")).alias("top_share"))


def co_missing_groups(df: DataFrame, threshold: float = 0.8) -> list[list[str]]:
    """Greedy groups of columns that are null together: a column joins the first whose nulls it mostly shares."""
    names = df.columns
    nulls = {c: F.col(f"`{c}`").isNull() for c in names}
    counts = df.agg(*[F.count_if(nulls[a] & nulls[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    both = lambda i, j: counts[f"{min(i, j)}_{max(i, j)}"]
    groups, used = [], set()
    for i in range(len(names)):
        if i in used or not both(i, i):
            continue
        group = [i, *(j for j in range(len(names)) if j != i and j not in used and both(i, j) / both(i, i) > threshold and both(j, j))]
        if len(group) > 1:
            groups.append([names[j] for j in group])
            used.update(group)
    return groups


def coerced_dates(df: DataFrame, least: float = 0.5) -> DataFrame:
    """df with the string columns named like dates cast to timestamps, where at least half of the values parse."""
    names = [f.name for f in df.schema if dtype_of(f.dataType) == "string" and any(h in f.name.lower() for h in DATE_HINTS)]
    if not names:
        return df
    parsed = {c: F.try_to_timestamp(F.col(f"`{c}`")) for c in names}
    rates = df.agg(*[(F.count(parsed[c]) / F.greatest(F.count(f"`{c}`"), F.lit(1))).alias(c) for c in names]).first()
    return df.withColumns({c: parsed[c] for c in names if rates[c] >= least})


def systematic_sample(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Every step-th row in the given order, step = ceil(rows / limit): positions are counted inside ranges of the order.

    Spark sorts by range; each range's size, summed over the ranges before it, gives the position of its first row. No
    task sees more than its range, unlike a window over the whole table.
    """
    step = -(-df.count() // limit) or 1
    # The bounds of the ranges are sampled anew by each job, so both jobs below must read one set of ranges.
    ranged = held(df.orderBy(*order))
    placed = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    before, total = {}, 0
    for part, n in sorted(placed.groupBy("__part").count().collect()):  # one row for each range
        before[part], total = total, total + n
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("__part")] if before else F.lit(0)
    return placed.where((F.col("__at") + offset) % step == 0).drop("__part", "__at").limit(limit)
