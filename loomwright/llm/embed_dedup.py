"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

The distinct vectors of a label are dealt into tiles of about TILE rows, and every pair of tiles is one task's work. Unit
vectors are quantised to int8, each with its own scale, and the length of what quantising lost is kept as its error. For
unit vectors u, v with quantised parts a, b and errors e, f:  |u.v - a.b| <= |a| |f| + |e|.  Only pairs whose int8
product plus that bound reaches the threshold are computed again, from the given components in double precision.

A pair of tiles passes on how many vectors each vector links with, and a spanning forest of its links: rows in proportion
to the tiles, however dense the links. Copies of a vector are one row that counts them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import connected_components, join_trees, stored

TILE = 2048


def usable(vector: str) -> Column:
    """True for a vector with components, all of them finite."""
    values = F.col(vector)
    fine = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(values) > 0) & fine, F.lit(False))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (held as float32, whose products of up to 1024 of them are exact), scales and lengths of the errors."""
    scales = np.abs(units).max(1) / 127
    values = np.rint(units / scales[:, None])
    return values.astype(np.float32), scales, np.linalg.norm(units - values * scales[:, None], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        total += a[:, at : at + 1024] @ b[:, at : at + 1024].T
    return total


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, rows: int = 256):
    """Pairs (i, j) with cosine(x[i], y[j]) >= threshold, in blocks; j > i where x and y are the same tile."""
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    units_x, units_y = x / norm_x[:, None], y / norm_y[:, None]
    qx, sx, ex = quantised(units_x)
    qy, sy, ey = quantised(units_y)
    for at in range(0, len(x), rows):
        part = slice(at, at + rows)
        close = products(qx[part], qy) * sx[part, None] * sy[None, :]
        bound = (1 + ex[part, None]) * ey[None, :] + ex[part, None] + 1e-9
        i, j = np.nonzero(close + bound >= threshold)
        i += at
        if same:
            i, j = i[j > i], j[j > i]
        for k in range(0, len(i), 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            sure = (x[a] * y[b]).sum(1) / (norm_x[a] * norm_y[b]) >= threshold
            if sure.any():
                yield a[sure], b[sure]


def linked_vectors(rows: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of rows (vec_id, embedding, label); others are not read.

    Vectors link within a label and length. A null, zero or empty vector, one with a null or non-finite component, and
    one without a label or id link with nothing: they are their own component. Rows that repeat are vectors of their
    own and link with one another; rows that share a vec_id are one node of the components. Rows without links keep
    themselves. An empty table gives an empty result.
    """
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    fit = usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0)
    groups = source.where(fit).groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(groups.withColumns({"width": F.size("v"), "node": F.monotonically_increasing_id()}))
    tiles = nodes.groupBy("label", "width").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    placed = nodes.join(tiles, ["label", "width"]).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    dealt = placed.select("label", "width", "tile", "node", "copies", "v", other).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other")

    def over(table: pa.Table) -> pa.Table:
        width, low, high = (table.column(c)[0].as_py() for c in ("width", "low", "high"))
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        ids, copies, first = (np.asarray(table.column(c)) for c in ("node", "copies", "tile"))
        first = first == low
        a = np.flatnonzero(first)
        b = a if low == high else np.flatnonzero(~first)
        labels, degree = np.arange(len(x)), np.zeros(len(x), np.int64)
        edges = []
        for i, j in tile_links(x[a], x[b], threshold, low == high) if len(a) and len(b) else ():
            i, j = a[i], b[j]
            np.add.at(degree, i, copies[j])
            np.add.at(degree, j, copies[i])
            chosen = join_trees(labels, i, j)
            edges.append(np.stack([ids[i[chosen]], ids[j[chosen]]], 1))
        pairs = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        linked = np.flatnonzero(degree)
        a, b = np.concatenate([pairs[:, 0], ids[linked]]), np.concatenate([pairs[:, 1], ids[linked]])
        return pa.table({"a": a, "b": b, "links": np.concatenate([np.zeros(len(pairs), np.int64), degree[linked]])})

    # A pair of tiles is much work for few bytes: a fixed number of partitions keeps Spark from merging pairs by their size.
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label", "width", "low", "high")
    found = stored(dealt.groupBy("label", "width", "low", "high").applyInArrow(over, "a long, b long, links long"))
    degrees = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    member = connected_components(found.where("a <> b").select("a", "b"))
    linked = nodes.join(degrees, "node", "left").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    known = linked.join(names, "component").select("label", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    fitting = source.where(fit).join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = source.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fitting.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
