"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words are exactly those at which bytes.split() splits: 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more rows than this is compared in pairs of tiles of about as many.
TILE = 8192
#: A list of ids up to this long is broadcast; a longer one is joined.
SHORT = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, unchanged, as UTF-8; none for null."""
    return text.encode().split() if text else []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or else under the folder that the context has for checkpoints.

    Where neither is set, as in tests, a temporary folder stands in on a local master; a cluster's executors share none.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return f"{base}/loomwright-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again, so that a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_rows(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint, for small tables inside loops."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def trimmed() -> None:
    """Gives the memory that a task has freed back to the system: workers outlive their tasks and share a limit."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mapped(df: DataFrame, over: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, rows: int = 512) -> DataFrame:
    """over, applied to slices of at most `rows` rows; it yields columns by name for the result's schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for columns in over(batch.slice(at, rows)):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
        trimmed()

    return df.mapInArrow(run, schema)


def by_key(df: DataFrame, key: str, columns: list[str], over: Callable[..., Iterator[dict]], schema: str, rows: int = 100_000) -> DataFrame:
    """over, applied to arrays of the columns, sorted by key; the rows of a key come together, with other keys'.

    For many small groups: a call handles about `rows` rows of a partition at once and holds no more than one key besides.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            keys, *values = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(keys) if last else int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            held[:] = [] if last else [[keys[end:], *(v[end:] for v in values)]]
            for found in over(*(v[:end] for v in values)) if end else ():
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

        waiting = 0
        for batch in batches:
            held.append([np.array(c) for c in batch.columns])
            waiting += batch.num_rows
            if waiting >= rows:
                yield from out(False)
                waiting = 0
        if held:
            yield from out(True)
        held.clear()
        trimmed()

    dealt = df.repartition(key).sortWithinPartitions(key).select(F.col(key).alias("__key"), *columns)
    return dealt.mapInArrow(run, schema)


def tiled(df: DataFrame, key: str, row: str, rows: int = TILE) -> DataFrame:
    """df with a column place for by_key(): the key itself, or a pair of tiles where the key has more than `rows` rows.

    Such a key's rows are dealt to tiles by a hash of the column `row`, and each is copied into every pair of tiles that
    holds its own: any two rows of the key meet in one place, and a place has the rows of two tiles at most. df is read
    twice. Places are hashes, so rows of other keys may come to one, and what meets is to be verified.
    """
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    large = kept_rows(large.select(key, F.ceil(F.col("n") / rows).cast("int").alias("__tiles")))
    some = large.limit(SHORT + 1).count()
    if not some:
        return df.withColumn("place", F.col(key))
    dealt = df.join(F.broadcast(large) if some <= SHORT else large, key, "left")
    other = F.explode(F.when(F.col("__tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__tiles") - 1)))
    dealt = dealt.withColumn("__own", F.pmod(F.xxhash64(row), F.col("__tiles"))).withColumn("__other", other)
    pair = F.xxhash64(key, F.least("__own", F.col("__other").cast("long")), F.greatest("__own", F.col("__other").cast("long")))
    return dealt.withColumn("place", F.when(F.col("__tiles").isNull(), F.col(key)).otherwise(pair)).drop("__own", "__other", "__tiles")


def joined_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with groups, one row for each key with the number of its rows: large groups are not shuffled.

    Groups of more than TILE rows are few, at most one in TILE rows. They are broadcast, if SHORT at most, so that a group
    of any size stays where its rows are read; the rest is joined by key.
    """
    large = kept_rows(groups.where(F.col(count) > TILE))
    some = large.limit(SHORT + 1).count()
    if not 0 < some <= SHORT:
        return rows.join(groups, key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.where(F.col(count) <= TILE), key)
    return rows.join(F.broadcast(large), key).unionByName(rest)


def held_out(doc_id: str, modulus: int) -> Column:
    """True where crc32 of the id as text leaves 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == 2


def join_trees(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of the pairs (a, b) that join two trees; labels, the root of each row, is updated."""
    chosen, live, place = [], np.arange(len(a)), np.empty(len(labels), np.int64)
    while len(live):
        x, y = labels[a[live]], labels[b[live]]
        differ = x != y
        live, high, low = live[differ], np.maximum(x, y)[differ], np.minimum(x, y)[differ]
        place[high] = np.arange(len(high))  # one hook for each root
        hook = np.unique(place[high]) if len(high) < len(labels) else np.flatnonzero(np.arange(len(high)) == place[high])
        chosen.append(live[hook])
        labels[high[hook]] = low[hook]
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]
    return np.concatenate(chosen) if chosen else live


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014) until no edge changes. Each round is two joins on a node
    with a grouped minimum that combines before the shuffle. A hub's edges, two numbers each, are one key of these joins,
    whose partitions Spark splits where they are skewed. The result of a round is a checkpoint.
    """
    graph = kept_rows(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        both = graph.union(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        graph = kept_rows(small.where("u <> v").distinct())
        now = graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = graph.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(graph.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
