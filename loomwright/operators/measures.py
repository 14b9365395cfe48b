"""Facts about a table that its column profile does not hold: what MEASURED of the rules stands for.

Every function returns a lazy frame: no job runs before the caller's own, and nothing is kept between queries.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators import profile as pf
from loomwright.operators.rules import CADENCE

NEAR_CONSTANT, PEARSON, LEAST_ROWS, CO_MISSING, ASSOCIATED, FEW = 0.95, 0.95, 20, 0.8, 0.80, 5
# Stored kinds and the detected ones that agree with them.
COMPATIBLE = [
    ("int", "Numeric"),
    ("float", "Numeric"),
    ("string", "Categorical"),
    ("string", "Text"),
    ("bool", "Boolean"),
    ("bool", "Categorical"),
    ("datetime", "DateTime"),
    ("object", "Categorical"),
    ("object", "Text"),
    ("object", "Unsupported"),
]


def column_sums(df: DataFrame) -> DataFrame:
    """(column_name, stored_as, n, numbers, times, pairs): one aggregation over all columns and pairs of a table.

    n counts values, numbers and times those of a string column that parse as such. pairs, the same in every row, holds
    co_missing, whether columns are null together, and pearson_pairs, how many rise or fall together.
    """
    kinds = {f.name: pf.dtype_of(f.dataType) for f in df.schema}
    null, names, zero = {c: F.col(f"`{c}`").isNull() for c in kinds}, list(kinds), F.lit(0).cast("long")
    sums, rows = [F.count(F.lit(1)).alias("n")], []
    for k, (name, kind) in enumerate(kinds.items()):
        n, a, b = (f"c{k}_{x}" for x in ("n", "a", "b"))
        sums.append(F.count(pf.present(name, kind)).alias(n))
        if kind == "string":
            sums += [F.count(F.expr(f"try_cast(`{name}` as double)")).alias(a), F.count(F.expr(f"try_cast(`{name}` as timestamp)")).alias(b)]
        numbers, times = (F.col(a), F.col(b)) if kind == "string" else (zero, zero)
        rows.append(F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("stored_as"), F.col(n).alias("n"), numbers.alias("numbers"), times.alias("times"), F.col("pairs").alias("pairs")))
    sums += [F.count_if(null[a] & null[b]).alias(f"m{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    numeric = [i for i, c in enumerate(names) if kinds[c] in ("int", "float")]
    pairs = [(i, j) for i in numeric for j in numeric if i < j]
    sums += [F.corr(f"`{names[i]}`", f"`{names[j]}`").alias(f"r{i}_{j}") for i, j in pairs]
    both = lambda i, j: F.col(f"m{min(i, j)}_{max(i, j)}")
    together = [(both(i, j) > CO_MISSING * both(i, i)) & (both(j, j) > 0) for i in range(len(names)) for j in range(len(names)) if i != j]
    strong = [F.when((F.col("n") >= LEAST_ROWS) & (F.abs(F.round(F.col(f"r{i}_{j}"), 4)) >= PEARSON), 1).otherwise(0) for i, j in pairs]
    found = {"co_missing": reduce(lambda a, b: a | b, together, F.lit(False)), "pearson_pairs": reduce(lambda a, b: a + b, strong, F.lit(0))}
    return df.agg(*sums).withColumn("pairs", F.struct(*[v.cast("double").alias(f) for f, v in found.items()])).select(F.inline(F.array(*rows)))


def detected_as(few: int) -> Column:
    """The kind of a column, from its column_sums and its number of values."""
    n, stored = F.col("n"), F.col("stored_as")
    text = F.when(F.col("numbers") == n, "Numeric").when(F.col("times") == n, "DateTime").otherwise("Text")
    number = F.when(F.col("unique_count") <= few, "Categorical").otherwise("Numeric")
    other = F.when(stored == "bool", "Boolean").when(stored == "datetime", "DateTime").otherwise("Unsupported")
    return F.when(n == 0, "Unsupported").when(stored == "string", text).when(stored.isin("int", "float"), number).otherwise(other)


def agrees() -> Column:
    """Whether the detected kind is one that the stored one stands for."""
    return reduce(lambda e, kv: e | ((F.col("stored_as") == kv[0]) & (F.col("detected_as") == kv[1])), COMPATIBLE, F.lit(False))


def detected_types(df: DataFrame, few: int = FEW) -> DataFrame:
    """(column_name, stored_as, detected_as): one aggregation over all columns, and their counted values.

    A column without values is Unsupported. A string column whose values all parse as numbers is Numeric, as times
    DateTime, and else Text. A number with up to `few` distinct values is Categorical.
    """
    found = column_sums(df).join(pf.value_stats(df), "column_name", "left")
    return found.select("column_name", "stored_as", detected_as(few).alias("detected_as"))


def type_mismatches(df: DataFrame) -> DataFrame:
    """The detected types that the stored ones do not stand for."""
    return detected_types(df).where(~agrees())


def text_heads(df: DataFrame, order: list[str], scan: int) -> DataFrame:
    """(column_name, value): the first non-null values of string columns, from one scan for all of them."""
    names = [f.name for f in df.schema if pf.dtype_of(f.dataType) == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    return pf.first_values(df.select(*{*names, *order}), names, order, scan).select("column_name", "value")


def personal(text: Column) -> Column:
    return (text != "") & (text.rlike(pf.EMAIL_VALUE) | text.rlike(pf.SSN_VALUE) | pf.person_name(text))


def dictionary_facts(dictionary: DataFrame, tables: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """(table_name, fact, value): what a dictionary (table_name, column_name, definition, data_type, consent, refresh) says.

    tables: the columns of each table with their dtypes. Names are compared without case.
    """
    spark = dictionary.sparkSession
    columns = spark.createDataFrame([(t, c.lower(), k, len(kinds)) for t, kinds in tables.items() for c, k in kinds.items()], "table_name string, __name string, __kind string, __columns int")
    known, declared = F.col("__kind").isNotNull(), F.lower(F.trim("data_type"))
    rows = dictionary.withColumn("__name", F.lower("column_name")).join(F.broadcast(columns), ["table_name", "__name"], "left")
    sums = {
        "entries": F.count(F.lit(1)), "matched": F.count_if(known), "documented": F.count_if(known & (F.trim(F.coalesce("definition", F.lit(""))) != "")),
        "coverage": F.coalesce(100.0 * F.count_distinct(F.when(known, F.col("__name"))) / F.max("__columns"), F.lit(0.0)), "dictionary_mismatches": F.count_if(known & (declared != "") & (declared != F.col("__kind"))),
        "approved": F.count_if(F.lower("consent") == "approved"), "denied": F.count_if(F.lower("consent") == "denied"), "cadence_known": F.count_if(F.col("refresh").rlike(CADENCE)),
    }
    found = rows.groupBy("table_name").agg(*[v.cast("double").alias(f) for f, v in sums.items()])
    return found.select("table_name", F.inline(F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).alias("value")) for f in sums])))


def measured(tables: Mapping[str, DataFrame], order: Mapping[str, list[str]], scan: int = 100) -> DataFrame:
    """(table_name, fact, value) of duplicate rows, near-constant and mistyped columns, personal values and related columns.

    Each table is read once for its sums, and once each for values, rows, first values and pairs of columns; what follows
    serves all tables at once. order: by which columns a table's first values are told.
    """
    spark = next(iter(tables.values())).sparkSession
    kind = "table_name string, column_name string, stored_as string, n long, numbers long, times long, pairs struct<co_missing:double,pearson_pairs:double>"
    sums = pf.of_tables(tables, column_sums) if tables else spark.createDataFrame([], kind)
    values = pf.counted_values(pf.of_tables(tables, pf.values_of), "table_name", "column_name")
    columns = sums.join(values, ["table_name", "column_name"], "left").withColumn("detected_as", detected_as(FEW))
    by_column = columns.groupBy("table_name").agg(
        F.count_if(F.col("top_count") / F.col("filled") >= NEAR_CONSTANT).cast("double").alias("near_constant"), F.count_if(~agrees()).cast("double").alias("mismatched"),
        F.max("pairs.co_missing").alias("co_missing"), F.max("pairs.pearson_pairs").alias("pearson_pairs"),
    )
    wide = by_column.select("table_name", F.inline(F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).alias("value")) for f in by_column.columns[1:]])))
    fact = lambda rows, name, value: rows.groupBy("table_name").agg(value.cast("double").alias("value")).select("table_name", F.lit(name).alias("fact"), "value")
    rows = pf.of_tables(tables, pf.row_keys).groupBy("table_name", "row").count()
    heads = reduce(DataFrame.union, [text_heads(df, order[t], scan).select(F.lit(t).alias("table_name"), "column_name", "value") for t, df in tables.items()])
    pairs = associations(pf.of_tables(tables, pair_values), "table_name")
    return reduce(DataFrame.union, [
        wide, fact(rows, "dup_rows", F.sum(F.col("count") - 1)), fact(heads.where(personal(F.trim("value"))), "pii_values", F.count_distinct("column_name")),
        fact(pairs.where(F.col("v") >= ASSOCIATED), "phik_pairs", F.count(F.lit(1))),
    ])


def associated_pairs(df: DataFrame, threshold: float = ASSOCIATED) -> DataFrame:
    """(column_a, column_b, v) of pairs of columns with Cramer's V of at least the threshold, corrected for bias."""
    return associations(pair_values(df)).where(F.col("v") >= threshold)


def associations(pairs: DataFrame, *key: str) -> DataFrame:
    """(*key, column_a, column_b, v) of pair_values: a pair's contingency table is one key of one shuffle, of few cells."""
    pair = [*key, "column_a", "column_b"]
    cells = pairs.groupBy(*pair, "x", "y").agg(F.sum("n").cast("double").alias("n")).repartition(*pair)
    total = lambda *more: F.sum("n").over(Window.partitionBy(*pair, *more))
    met = cells.withColumns({"nx": total("x"), "ny": total("y"), "all": total()})
    stats = met.groupBy(*pair).agg((F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))) - 1).alias("phi2"), F.size(F.collect_set("x")).alias("r"), F.size(F.collect_set("y")).alias("c"), F.max("all").alias("m"))
    r, c, m = F.col("r"), F.col("c"), F.col("m")
    phi2 = F.greatest(F.lit(0.0), F.col("phi2") - (r - 1) * (c - 1) / (m - 1))
    least = F.least(r - (r - 1) * (r - 1) / (m - 1), c - (c - 1) * (c - 1) / (m - 1)) - 1
    return stats.where("r > 1 and c > 1 and m > 1").select(*pair, F.round(F.sqrt(phi2 / F.when(least > 0, least)), 3).alias("v"))


def pair_values(df: DataFrame, bins: int = 10, most: int = 50) -> DataFrame:
    """(column_a, column_b, x, y, n): the cells of the contingency tables of all pairs of columns, a cell in several rows.

    Numbers with more than `bins` values fall into that many equal bins from their least to their largest; another column
    with more than `most` values takes no part, as all its cells would hold one row. Ranges and numbers of values are one
    row each, scalar subqueries of the scan.
    """
    kinds = {f.name: pf.dtype_of(f.dataType) for f in df.schema}
    names = [c for c, k in kinds.items() if k in ("int", "float", "string", "bool")]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, x string, y string, n long")
    number = {c for c in names if kinds[c] in ("int", "float")}
    counts = [F.coalesce(F.max(F.when(F.col("column_name") == c, F.col("unique_count"))), F.lit(0)).alias(f"u{i}") for i, c in enumerate(names)]
    ends = [f(F.col(f"`{c}`").cast("double")).alias(f"{s}{i}") for i, c in enumerate(names) if c in number for s, f in (("lo", F.min), ("hi", F.max))]
    known = pf.value_stats(df, names).agg(*counts).select(F.struct("*").alias("known")).scalar()
    ranges = df.agg(*ends, F.count(F.lit(1)).alias("n")).select(F.struct("*").alias("ranges")).scalar()
    values = {}
    for i, c in enumerate(names):
        v, u = F.col(f"`{c}`"), F.col("__known")[f"u{i}"]
        plain = F.when(u <= (bins if c in number else most), v.cast("string"))
        if c in number:
            lo, hi = F.col("__ranges")[f"lo{i}"], F.col("__ranges")[f"hi{i}"]
            width = (hi - lo) / bins
            plain = F.when(u > bins, F.least(F.floor((v.cast("double") - lo) / F.when(width > 0, width)), F.lit(bins - 1)).cast("string")).otherwise(plain)
        values[c] = plain
    place = {c: f"v{i}" for i, c in enumerate(names)}
    every = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(place[a]).alias("x"), F.col(place[b]).alias("y")) for a, b in pairs])
    # Rows that agree in all binned values are counted first: pairs are made of few rows.
    binned = df.withColumns({"__known": known, "__ranges": ranges}).select(*[values[c].alias(place[c]) for c in names]).groupBy(*place.values()).agg(F.count(F.lit(1)).alias("n"))
    return binned.select("n", F.inline(every)).where("x is not null and y is not null").select("column_a", "column_b", "x", "y", "n")
