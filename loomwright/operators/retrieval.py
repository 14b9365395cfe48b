"""Similarity search, access filters, context assembly and retrieval metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Queries and points in a block of the search.
QUERIES, POINTS = 4096, 16_384


def best_of_blocks(group: pa.Table, k: int, threshold: float) -> pa.Table:
    """(query_id, point_id, score): the k best points of a block for each of its queries, of rows (id, v, asks)."""
    ids, asks = np.asarray(group.column("id")), group.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
    v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    unit = v / np.where(length > 0, length, 1)
    targets, rows = ids[~asks], unit[~asks]
    out: list[tuple[np.ndarray, ...]] = []
    for q, x in zip(ids[asks], unit[asks], strict=True) if len(rows) else ():
        score = rows @ x
        at = np.flatnonzero(score >= max(threshold, np.partition(score, -k)[-k] if len(score) > k else -np.inf))
        at = at[np.lexsort((targets[at], -score[at]))[:k]]
        out.append((np.full(len(at), q), targets[at], score[at]))
    found = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table(dict(zip(("query_id", "point_id", "score"), found, strict=True)))


def nearest(queries: DataFrame, points: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """(query_id, rank, point_id, score) by cosine, ties to smaller ids; a vector of length zero scores 0.

    queries (query_id, q) against all of points (point_id, v): blocks of queries meet blocks of points in matrix products
    that keep the best k of each query, so the final window sees k rows for each query and block of points. Null vectors
    and ids take no part; vectors of different lengths do not meet.
    """
    blocks = lambda df, rows: max(1, -(-df.count() // rows))
    some = queries.where("query_id is not null and q is not null").select(F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("v"), F.lit(True).alias("asks"))
    every = points.where("point_id is not null and v is not null").select(F.col("point_id").alias("id"), F.col("v").cast("array<double>").alias("v"), F.lit(False).alias("asks"))
    m, n = blocks(some, QUERIES), blocks(every, POINTS)
    spread = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    own = lambda name, count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias(name)
    dealt = some.select(own("a", m), spread("b", n), "id", "v", "asks").union(every.select(spread("a", m), own("b", n), "id", "v", "asks"))

    best = lambda group: best_of_blocks(group, k, threshold)
    pairs = dealt.groupBy("a", "b", F.size("v").alias("width")).applyInArrow(best, "query_id long, point_id long, score double")
    whole = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return pairs.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("query_id", "rank", "point_id", "score")


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall at each k, mean reciprocal rank and nDCG over the queries of expected (query_id, point_id)."""
    hit = expected.join(ranked, ["query_id", "point_id"], "left")
    rank = F.col("rank")
    recalls = [F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks]
    return hit.agg(*recalls, F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"), F.avg(F.coalesce(1.0 / F.log2(1.0 + rank), F.lit(0.0))).alias("ndcg"))


def allowed(chunks: DataFrame, acl: DataFrame) -> DataFrame:
    """Chunks (chunk_id, product, document, field) that a list of grants (access, value) opens; no grants open nothing.

    full opens all, index a product, document a document: hash semi-joins. field compares names by containment in either
    direction, a nested loop that sees only the distinct fields of the chunks and the grants.
    """
    grant = lambda kind, column: acl.where(F.col("access") == kind).select(F.col("value").alias(column)).distinct()
    low = lambda c: F.lower(F.col(c))
    named = low("field").contains(low("granted")) | low("granted").contains(low("field"))
    fields = chunks.select("field").distinct().join(grant("field", "granted"), named, "left_semi")
    opens = lambda found, *keys: found.select(*keys, F.lit(True).alias("__" + (keys or ["all"])[0]))
    joined = chunks.join(opens(grant("index", "product"), "product"), "product", "left").join(opens(grant("document", "document"), "document"), "document", "left")
    joined = joined.join(opens(fields, "field"), "field", "left").join(acl.agg(F.coalesce(F.bool_or(F.col("access") == "full"), F.lit(False)).alias("__all")))
    granted = F.coalesce("__product", "__document", "__field", F.lit(False)) | F.col("__all")
    return joined.where(granted).select(chunks.columns).dropDuplicates(["chunk_id"])


def within_budget(rows: DataFrame, group: str, order: list[str | Column], size: Column, budget: int) -> DataFrame:
    """The rows of each group, in order, while their sizes add up to the budget at most."""
    running = F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", running).where(F.col("used") <= budget)


# Fixed values.
NEGATIONS = ["not", "no", "never", "cannot", "can't", "won't", "doesn't", "don't", "isn't", "aren't"]
FILLERS = ["the", "a", "an", "is", "are", "was"]


def conflicts(chunks: DataFrame, context: str, most: int = 3) -> DataFrame:
    """(context, rank, term, negated_in, stated_in): terms of over 4 letters that a chunk of one document has with a negation
    and an earlier chunk of another document without.

    One term a chunk, the first by name, and the first `most` chunks of a context. A term belongs to the document of the
    first chunk that states it. Null texts have no terms.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    told = chunks.select(context, "rank", "doc", words.alias("words")).withColumn("negated", F.arrays_overlap("words", F.array(*map(F.lit, NEGATIONS))))
    terms = told.select(context, "rank", "doc", "negated", F.explode("words").alias("term")).where((F.length("term") > 4) & ~F.col("term").isin(NEGATIONS + FILLERS))
    stated = terms.where("not negated").groupBy(context, "term").agg(F.min("rank").alias("since"), F.min_by("doc", "rank").alias("stated_in"))
    against = terms.where("negated").join(stated, [context, "term"]).where("since < rank and stated_in <> doc")
    one = against.groupBy(context, "rank").agg(F.min(F.struct("term", F.col("doc").alias("negated_in"), "stated_in")).alias("c"))
    order = Window.partitionBy(context).orderBy("rank")
    return one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(context, "rank", "c.*")
