"""Lineage as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reach(edges: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, depth) of what edges (src, dst) lead to from start (node), at the least depth.

    One join for each hop over the newest nodes only; it ends where a hop finds nothing new. The edges are materialised
    once, and so is every hop's result, in which the nodes seen so far are one table.
    """
    edges = held(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = held(start.select("node", F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth + 1):
        newest = seen.where(F.col("depth") == depth - 1)
        step = edges.join(newest, edges.src == newest.node, "left_semi").select(F.col("dst").alias("node"), F.lit(depth).alias("depth"))
        wider = held(seen.union(step).groupBy("node").agg(F.min("depth").alias("depth")))
        seen = wider
        if wider.where(F.col("depth") == depth).isEmpty():
            break
    return seen


def held(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names; in memory and on disk where it names none, as in tests."""
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None and folder:
        context.setCheckpointDir(folder)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def duplicate_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.groupBy(*keys).count().where("count > 1")


def orphans(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with an end that is no vertex."""
    known = vertices.select("node")
    return edges.join(known.withColumnRenamed("node", "src"), "src", "left_anti").union(edges.join(known.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")).distinct()
