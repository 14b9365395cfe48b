"""Exact order statistics without sorting or holding all values in one task.

A sketch brackets each rank between two values, with twice its error to either side. What lies below a bracket is only
counted, what lies above is dropped; the values inside, about RANKS of all rows, are counted by value and summed up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch: a rank is known to rows / ACCURACY, and a bracket holds 4 rows in ACCURACY. Below FEW rows all
#: values are inside.
ACCURACY, FEW = 10_000, 20_000
RANKS = 4 / ACCURACY


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, probabilities: list[float], upper: bool = False) -> DataFrame:
    """(*keys, probability, value) for each key of rows with a value: percentiles, interpolated as numpy's are by default.

    upper: the next value above instead, the upper median for 0.5. Nulls and NaN are left out. There should be few keys, as
    columns of a table are: their brackets are broadcast. Two passes over rows.
    """
    x = F.col(value).cast("double")
    some = rows.select(*keys, x.alias("__x")).where(x.isNotNull() & ~F.isnan(x))
    low, high = ([min(1.0, max(0.0, p + s * 2 / ACCURACY)) for p in probabilities] for s in (-1, 1))
    bounds = [F.percentile_approx("__x", q, ACCURACY).alias(f"__{name}") for q, name in ((low, "low"), (high, "high"))]
    brackets = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *bounds)
    met = some.join(F.broadcast(brackets), keys) if keys else some.join(F.broadcast(brackets))

    def place(k: int) -> Column:
        """The value inside a bracket, one mark for all below it, and null above."""
        few, v = F.col("__n") < FEW, F.col("__x")
        return F.when(few, v).when(v < F.col("__low")[k], float("-inf")).when(v <= F.col("__high")[k], v)

    marks = F.array(*[F.struct(F.lit(k).alias("__k"), place(k).alias("__v")) for k in range(len(probabilities))])
    counted = met.select(*keys, "__n", F.inline(marks)).where("__v is not null").groupBy(*keys, "__k", "__v").agg(F.count(F.lit(1)).alias("c"), F.max("__n").alias("__n"))
    order = Window.partitionBy(*keys, "__k").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = F.get(F.array(*map(F.lit, probabilities)), F.col("__k"))
    at = F.floor(p * F.col("__n")).cast("double") if upper else p * (F.col("__n") - 1)
    at = F.least(at, (F.col("__n") - 1).cast("double"))
    sums = counted.withColumns({"__upto": F.sum("c").over(order), "__at": at})
    first = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__v")))
    found = sums.groupBy(*keys, "__k").agg(first(F.floor("__at")).alias("a"), first(F.ceil("__at")).alias("b"), F.max("__at").alias("__at"))
    share = F.col("__at") - F.floor("__at")
    return found.select(*keys, p.alias("probability"), F.when(share > 0, F.col("a") + (F.col("b") - F.col("a")) * share).otherwise(F.col("a")).alias(value))
