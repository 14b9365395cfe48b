"""Exact top-k by inner product with a pivot table.

Vectors become integers. Every row keeps its distances to many pivots, rows of a sample that stand highest above the span of
those before. Distances to pivots fix where a point stands in that span (its foot) and how far above it (its height), so
the largest lower bound of d(q, x) that all of them give together is the distance of the two feet with the heights apart on
one axis. It is never below any single pivot's |d(q, p) - d(x, p)|. As d(q, x)^2 = |q|^2 + |x|^2 - 2 q.x, it is an upper
bound of the score: foot(q).foot(x) + height(q) height(x).

A row belongs to the cell of the nearest of CELLS pivots; a cell keeps its radius. Queries first meet a sample of rows of a
fixed size, whose k-th score is a floor. They are dealt to the cells whose bound |q| radius + q.pivot reaches the floor, and
to no others; a cell's rows are dealt once for each QUERIES queries. There a query's rows whose bound reaches the floor are
evaluated in the order of their bounds, until the next bound is below the k-th score found. What is left out provably scores
below k others. Each result row tells how many rows its query was evaluated against.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import stored
from loomwright.llm.embed_dedup import usable

#: Rows of the sample of a width, cells, and pivots at most.
SAMPLE, CELLS, PIVOTS = 4096, 16, 256
#: Rows in a block of a cell, and queries in a block.
ROWS, QUERIES = 32_768, 32_768


@dataclass
class Pivots:
    """The pivots of one width, and the map from distances to feet; sample: rows that every query meets first."""

    rows: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, ids: np.ndarray, most: int) -> Pivots:
        """Greedy: the next pivot is the sample row that stands highest above the span of the pivots so far."""
        chosen, rest = [0], sample - sample[0]
        height = (rest * rest).sum(1)
        least = 1e-6 * height.max(initial=0)
        while len(chosen) < most and (at := int(height.argmax())) >= 0 and height[at] > max(least, 1e-9):
            axis = rest[at] / np.sqrt(height[at])
            rest = rest - (rest @ axis)[:, None] * axis
            height = (rest * rest).sum(1)
            chosen.append(at)
        return cls(sample[chosen], sample, ids)

    def prepare(self) -> Pivots:
        self.squares = (self.rows * self.rows).sum(1)
        edges = self.rows[1:] - self.rows[0]
        self.edges = (edges * edges).sum(1)
        upper = np.linalg.qr(edges.T, "r") if len(edges) else np.zeros((0, 0))
        self.to_foot = np.linalg.inv(upper) if len(edges) else upper
        #: Relative error of a foot or a squared height, with a margin.
        self.slack = 1e-13 * (np.linalg.cond(upper) if len(edges) else 1.0) + 1e-11
        return self

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + self.squares - 2 * x @ self.rows.T, 0))

    def feet(self, away: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feet and heights over the first pivot, from distances to the pivots, and how wrong their squares may be."""
        squares = away * away
        feet = (squares[:, :1] - squares[:, 1:] + self.edges) / 2 @ self.to_foot
        error = self.slack * (squares[:, 0] + 1)
        return feet, np.sqrt(np.maximum(squares[:, 0] - (feet * feet).sum(1), 0) + error), error


def bounds(q: tuple[np.ndarray, ...], x: tuple[np.ndarray, ...], square_q: np.ndarray, square_x: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries and rows by their feet, heights and squared lengths."""
    (fq, hq, eq), (fx, hx, ex) = q, x
    least = (fq * fq).sum(1)[:, None] + (fx * fx).sum(1) - 2 * fq @ fx.T + (hq[:, None] - hx) ** 2  # squared distance at least
    return (square_q[:, None] + square_x - least) / 2 + 4 * (eq[:, None] + ex) + 1e-6


def best_rows(query: np.ndarray, bound: np.ndarray, floor: float, rows: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best scores and ids of a block for one query, ties to smaller ids, and how many rows were evaluated."""
    order = np.flatnonzero((bound >= floor) & (ids != own))
    order = order[np.argsort(-bound[order], kind="stable")]
    scores, found = np.zeros(0), np.zeros(0, np.int64)
    at, step = 0, 4 * k
    while at < len(order):
        part = order[at : at + step]
        scores, found = np.concatenate([scores, rows[part] @ query]), np.concatenate([found, ids[part]])
        top = np.lexsort((found, -scores))[:k]
        scores, found = scores[top], found[top]
        at, step = at + len(part), min(2 * step, 2048)
        if at < len(order) and len(scores) == k and bound[order[at]] < scores[-1]:
            break
    return scores, found, at


def top_k(rows: DataFrame, every: int = 50, k: int = 5, scale: int = 256, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score and evaluated: for each row whose vec_id is divisible by `every`, the k best other rows.

    A component x counts as floor(scale * x). A null or empty vector, one with a null or non-finite component and a row
    without vec_id take no part; a query and a row of different lengths do not meet. Rows with the query's vec_id are
    its own and no candidates; queries that share a vec_id are one, with the smallest vector. Fewer than k candidates
    are all returned. An empty table gives an empty result; other columns are not read. Pivots number three quarters of
    the length, `pivots` at most. Widths take their pivots from a sample of `sample` rows each, and there should be few
    of them: each has its sample and cells on the driver.
    """
    spark = rows.sparkSession
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    source = source.where(usable("v") & F.col("vec_id").isNotNull())
    whole = source.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")).withColumn("width", F.size("v"))
    counts = {r["width"]: r["n"] for r in whole.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.element_at(F.create_map(*[F.lit(x) for w, n in counts.items() for x in (int(w), sample / n)]), F.col("width")) if counts else F.lit(0.0)
    some = whole.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= share * float(1 << 30)).distinct().toArrow()
    widths = np.asarray(some.column("width"))
    tables: dict[int, Pivots] = {}
    for width in counts:
        part = some.filter(pa.array(widths == width)).sort_by([("vec_id", "ascending")])
        matrix, ids = np.array(part.column("v").to_pylist(), float).reshape(-1, width), np.asarray(part.column("vec_id"))
        order = np.lexsort((*matrix.T[::-1], ids))
        tables[width] = Pivots.of(matrix[order] if len(order) else np.zeros((1, width)), ids[order], min(pivots, max(2, 3 * width // 4 + 1))).prepare()
    known = spark.sparkContext.broadcast(tables)

    def measured(batches):
        for batch in batches:
            vectors, ids = batch.column("v").to_pylist(), np.asarray(batch.column("vec_id"))
            lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
            away, cell, floor = [None] * len(vectors), np.zeros(len(vectors), np.int32), np.full(len(vectors), -np.inf)
            for width in np.unique(lengths).tolist():
                table, at = known.value[width], np.flatnonzero(lengths == width)
                x = np.array([vectors[i] for i in at])
                far = table.distances(x)
                cell[at] = far[:, :CELLS].argmin(1)
                new = np.append(True, table.sample_ids[1:] != table.sample_ids[:-1])[: len(table.sample_ids)]
                for i, row, distances in zip(at.tolist(), x, far, strict=True):
                    away[i] = distances
                    if ids[i] % every == 0 and new.any():
                        sure = (table.sample @ row)[new & (table.sample_ids != ids[i])]
                        floor[i] = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
            extra = [pa.array(away, pa.list_(pa.float64())), pa.array(cell), pa.array(floor)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "away", "cell", "floor"])

    table = stored(whole.mapInArrow(measured, "vec_id long, v array<double>, width int, away array<double>, cell int, floor double"))
    queries = table.where(F.col("vec_id") % every == 0).groupBy("vec_id", "width").agg(F.min(F.struct("v", "away", "floor")).alias("s")).select("vec_id", "width", "s.*")
    chunks = {r["width"]: -(-r["n"] // QUERIES) for r in queries.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = table.groupBy("width", "cell").agg(F.max(F.element_at("away", F.col("cell") + 1)).alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    cells = {(r["width"], r["cell"]): (r["radius"], -(-r["n"] // ROWS)) for r in sizes if r["width"] in chunks}
    dealt_to = spark.createDataFrame([(w, c, b, chunks[w]) for (w, c), (_, b) in cells.items()], "width int, cell int, blocks int, chunks int")

    def asked(batches):
        """Each query once for every block of a cell that may hold one of its k best."""
        for batch in batches:
            take, cell, block, chunk = [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("vec_id", "width", "v", "floor")), strict=True)
            for number, (own, width, v, floor) in enumerate(rows):
                q = np.array(v)
                for (w, c), (radius, blocks) in cells.items():
                    if w == width and q @ known.value[w].rows[c] + np.linalg.norm(q) * radius * (1 + 1e-9) + 1e-6 >= floor:
                        take += [number] * blocks
                        cell += [c] * blocks
                        block += range(blocks)
                        chunk += [own // every % chunks[w]] * blocks
            part = batch.take(pa.array(take, pa.int64()))
            places = [pa.array(x, pa.int32()) for x in (cell, block, chunk)]
            yield pa.RecordBatch.from_arrays([part.column("width"), *places, *(part.column(c) for c in ("vec_id", "v", "away", "floor"))], names=columns)

    columns = ["width", "cell", "block", "chunk", "vec_id", "v", "away", "floor"]
    schema = "width int, cell int, block int, chunk int, vec_id long, v array<double>, away array<double>, floor double"
    offered = table.join(F.broadcast(dealt_to), ["width", "cell"]).withColumns({
        "block": F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int"), "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})

    def over(group: pa.Table) -> pa.Table:
        width = group.column("width")[0].as_py()
        table = known.value[width]
        matrix = lambda c, n: group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        x, away = matrix("v", width), matrix("away", len(table.rows))
        ids, asks, floors = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("vec_id", "asks", "floor"))
        rows, row_ids, square, feet = x[~asks], ids[~asks], (x * x).sum(1), table.feet(away)
        out = {"query_id": [], "vec_id": [], "score": [], "evaluated": []}
        which = np.flatnonzero(asks)
        step = max(1, (4 << 20) // max(1, len(rows)))
        for at in range(0, len(which) if len(rows) else 0, step):
            part = which[at : at + step]
            limit = bounds([f[part] for f in feet], [f[~asks] for f in feet], square[part], square[~asks])
            for q, bound in zip(part, limit, strict=True):
                scores, found, evaluated = best_rows(x[q], bound, floors[q], rows, row_ids, ids[q], k)
                out["query_id"].append(np.full(len(found), ids[q]))
                out["vec_id"].append(found)
                out["score"].append(scores.astype(np.int64))
                out["evaluated"].append((np.arange(len(found)) == 0) * evaluated)
        return pa.table({n: np.concatenate(c) if c else np.zeros(0, np.int64) for n, c in out.items()})

    # A block is much work for few bytes: a fixed number of partitions keeps Spark from merging blocks by their size.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = queries.mapInArrow(asked, schema).withColumn("asks", F.lit(True)).union(offered.select(columns).withColumn("asks", F.lit(False)))
    work = work.repartition(parts, "width", "cell", "block", "chunk")
    found = work.groupBy("width", "cell", "block", "chunk").applyInArrow(over, "query_id long, vec_id long, score long, evaluated long")
    order, group = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"), Window.partitionBy("query_id")
    ranked = found.withColumns({"rank": F.row_number().over(order), "evaluated": F.sum("evaluated").over(group)})
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "evaluated")
