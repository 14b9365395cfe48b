"""Approximate nearest neighbours by cosine: inverted lists around centroids, stored as partitions of a Parquet table.

Centroids are fitted on a sample of bounded size; every point is then dealt to the lists of its two nearest centroids and
written there, so that a query near the border of a list need not probe both sides. A search probes, for each query, the lists of its nearest centroids. A list is a folder: lists that no query
probes are not read, and a filter on the points' columns is pushed into the scan of those that are. With all lists probed the
result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.operators.retrieval import best_of_blocks

#: Rows of the sample that centroids are fitted on, rounds of the fit, and rows of a block of a list.
SAMPLE, ROUNDS, ROWS = 50_000, 12, 16_384
#: Lists that hold each point.
COPIES = 2
#: Queries in a block.
QUERIES = 4096


def units(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def centroids_of(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: seeds far apart, a list that runs empty takes the row that lies worst."""
    chosen, closest = [0], sample @ sample[0]
    while len(chosen) < min(lists, len(sample)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, sample @ sample[chosen[-1]])
    centres = sample[chosen].copy()
    for _ in range(rounds):
        score = sample @ centres.T
        own = score.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(score.max(1))[: len(empty)]]
        centres = units(sums)
    return centres


@dataclass
class VectorIndex:
    """Where the lists are, and their centroids; kept beside them, so that an index can be opened again."""

    path: str
    centroids: np.ndarray
    schema: str

    def points(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/lists")


def build_index(points: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, copies: int = COPIES) -> VectorIndex:
    """Writes the index of points (point_id, v, other columns) to a new folder and returns it.

    lists: sqrt(rows) by default, 4096 at most. The sample takes rows by a hash of their ids, `sample` by and large; every
    row is indexed but those without id or vector and those whose length is not the most frequent one. Null components
    count as zero. A list of many rows is written as several files.
    """
    spark = points.sparkSession
    rows = points.where("point_id is not null and v is not null and size(v) > 0").withColumn("v", F.transform("v", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))))
    sizes = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width, count = (sizes["width"], sizes["count"]) if sizes else (0, 0)
    rows = rows.where(F.size("v") == width)
    lists = min(4096, max(1, lists or math.isqrt(count)))
    share = min(1.0, sample / max(count, 1))
    some = rows.where(F.pmod(F.xxhash64("point_id"), F.lit(1 << 30)) <= share * (1 << 30)).select("point_id", "v").limit(2 * sample).toArrow().sort_by([("point_id", "ascending")])
    matrix = units(np.array(some.column("v").to_pylist(), float).reshape(-1, width)) if some.num_rows else np.zeros((1, width))
    centres = centroids_of(matrix, lists)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("v"))
            score = units(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)) @ centres.T
            own = np.argsort(-score, axis=1, kind="stable")[:, :copies].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.mapInArrow(assigned, schema + ", lists array<int>").withColumn("list", F.explode("lists")).drop("lists")
    blocks = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("blocks"))
    placed = dealt.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("point_id"), "blocks").cast("int")).drop("blocks")
    placed.repartition("list", "block").write.partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    schema += ", block int, list int"
    spark.createDataFrame([(schema,)], "columns string").write.parquet(f"{path}/schema")
    return VectorIndex(path, centres, schema)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return VectorIndex(path, np.array([r["centroid"] for r in rows]), spark.read.parquet(f"{path}/schema").first()[0])


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, where: Column | str | None = None, threshold: float | None = None) -> DataFrame:
    """(query_id, rank, point_id, score) by cosine, ties to smaller ids, for queries (query_id, q).

    Each query meets the points of its `probes` nearest lists that satisfy `where`, a condition on the points' columns.
    Rows that share a point_id are one point, at its best score.
    A threshold of zero or None keeps every score. A query of another length, or null, finds nothing.
    """
    spark, centres = queries.sparkSession, index.centroids
    many, width = min(probes, len(centres)), centres.shape[1]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = units(batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)) @ centres.T
            nearest = np.argsort(-score, axis=1, kind="stable")[:, :many].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), pa.array(nearest.tolist(), pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    kind = queries.schema["query_id"].dataType.simpleString()
    some = queries.where("query_id is not null and q is not null").select("query_id", F.transform("q", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("q")).where(F.size("q") == width)
    asked = some.mapInArrow(probed, f"query_id {kind}, q array<double>, lists array<int>").select("query_id", "q", F.explode("lists").alias("list"))
    points = index.points(spark)
    points = (points.where(where) if where is not None else points).select("list", "block", "point_id", "v")
    # Blocks of lists and queries meet: each is copied to the other's blocks of the list, whose number the stored list bounds.
    blocks = points.groupBy("list").agg(F.max("block").alias("last"))
    chunks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"))
    of_queries = asked.join(F.broadcast(blocks), "list").join(F.broadcast(chunks), "list").select(
        "list", F.explode(F.sequence(F.lit(0), "last")).alias("block"), F.pmod(F.xxhash64("query_id"), "chunks").cast("int").alias("chunk"), F.col("query_id").alias("id"), F.col("q").alias("v"), F.lit(True).alias("asks"))
    of_points = points.join(F.broadcast(chunks), "list").select("list", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("point_id").alias("id"), "v", F.lit(False).alias("asks"))
    pairs = of_queries.union(of_points).groupBy("list", "block", "chunk").applyInArrow(lambda group: best_of_blocks(group, k, threshold or -2.0), "query_id long, point_id long, score double")
    whole = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    pairs = pairs.groupBy("query_id", "point_id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("query_id", "rank", "point_id", "score")


def scrolled(index: VectorIndex, spark: SparkSession, after: object | None, most: int, where: Column | str | None = None) -> DataFrame:
    """The next `most` points after an id, in the order of their ids, each once: the last id is the cursor of the next page.

    A page reads the ids beyond the cursor, pushed into the scan, and keeps the first of each task; a point that is added
    later with a larger id is met by a later page, so that a scan can go on where another ended.
    """
    points = index.points(spark)
    points = points.where(where) if where is not None else points
    beyond = points if after is None else points.where(F.col("point_id") > F.lit(after))
    return beyond.drop("list", "block").dropDuplicates(["point_id"]).orderBy("point_id").limit(most)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the mean share of exact (query_id, point_id) that was found for each query."""
    hits = exact.select("query_id", "point_id").join(found.select("query_id", "point_id", F.lit(1).alias("hit")), ["query_id", "point_id"], "left")
    each = hits.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg("share").alias("recall"))
