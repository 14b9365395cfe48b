"""A quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of whole texts are standardised and mapped to D cosines whose inner products approximate a Gaussian kernel
(Rahimi and Recht, 2007). Each partition sums its own normal equations; the sums of D + 1 rows are added by Spark, and
the driver solves one (D + 1) x (D + 1) system, whatever the corpus. The ridge score is calibrated by isotonic
regression over a fixed number of score bins, each with the count and the sum of its labels, on labelled rows that the
ridge was not fitted on.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import held_out, mapped, stored

FEATURES = 256
RIDGE = 1.0
BINS = 4096
SEED = 20240517
#: Byte classes whose shares of the text are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:", "loud": b"!?",
    "sign": b"#$%&*@^~=+_", "bar": b"|\\/<>{}[]", "quote": b"\"'()-", "space": b" \t", "line": b"\n\r", "wide": bytes(range(128, 256)), "control": bytes([*range(9), *range(14, 32), 127]),
}
TABLE = np.zeros((256, len(CLASSES)))
for column, members in enumerate(CLASSES.values()):
    TABLE[list(members), column] = 1
STATISTICS = [*CLASSES, "log_bytes", "log_words", "word_length", "long_words", "distinct_words", "top_word", "distinct_lines", "words_a_line", "entropy", "odd_words", "loud_words", "capital_words"]


def statistics_of(text: str | None) -> np.ndarray:
    """The statistics of one whole text; zeros for null or empty."""
    out = np.zeros(len(STATISTICS))
    raw = (text or "").encode()
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts / len(raw)
    out[: len(CLASSES)] = shares @ TABLE
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    seen = shares[shares > 0]
    rest = [np.log1p(len(raw)), np.log1p(n), 0, 0, 0, 0, 0, 0, -(seen * np.log2(seen)).sum(), 0, 0, 0]
    if n:
        tally = Counter(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        rest[2:8] = [lengths.mean(), (lengths > 20).mean(), len(tally) / n, max(tally.values()) / n, len(set(lines)) / len(lines), np.log1p(n / len(lines))]
        odd = loud = capital = 0
        for word, times in tally.items():
            last = word[-1]
            odd += times * (not (word[0] >= 128 or word[:1].isalnum()) or (last < 128 and not word[-1:].isalnum() and last not in b".,;:!?\"')"))
            loud += times * (last in b"!?")
            capital += times * word.isupper()
        rest[9:] = [odd / n, loud / n, capital / n]
    out[len(CLASSES) :] = rest
    return out


def document_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, stats array<double>) for every row: one pass, no shuffle."""

    def over(batch: pa.RecordBatch):
        yield {"doc_id": batch.column(0), "stats": [statistics_of(x) for x in batch.column(1).to_pylist()]}

    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text), over, "doc_id long, stats array<double>")


@dataclass
class QualityModel:
    """mean, scale: of the statistics; weights, shift: of the cosines; beta: ridge; edges, values: isotonic steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    beta: np.ndarray | None = None
    edges: np.ndarray | None = None
    values: np.ndarray | None = None

    def mapped(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.weights + self.shift), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.mapped(stats) @ self.beta

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores from 0 to 1."""
        if not len(stats):
            return np.zeros(0)
        raw = np.round(self.raw(stats), 9)  # products round by the number of rows that they are taken with
        return np.clip(np.interp(raw, self.edges, self.values), 0, 1)


def isotonic(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for n, s in zip(counts, sums, strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s1, n1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s1, blocks[-1][1] + n1, blocks[-1][2] + k1]
    return np.concatenate([np.full(k, s / n) for s, n, k in blocks])


def fit_quality(rows: DataFrame) -> QualityModel:
    """The model of rows (stats, label 0 or 1, calibrates). Rows may repeat. No rows: every score is 0.5.

    The ridge is fitted on the rows that do not calibrate and the isotonic steps on those that do; where either has no
    rows, both use all.
    """
    d = len(STATISTICS)
    sides = {r["calibrates"] for r in rows.select("calibrates").distinct().collect()}
    fitting, calibrating = (rows.where("not calibrates"), rows.where("calibrates")) if len(sides) == 2 else (rows, rows)
    sums = rows.select(F.count(F.lit(1)), *[f(F.col("stats")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(SEED)
    mean = np.array([sums[1 + 2 * i] or 0 for i in range(d)])
    scale = np.array([sums[2 + 2 * i] or 0 for i in range(d)])
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1), rng.standard_normal((d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES))
    if not sums[0]:
        model.beta, model.edges, model.values = np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5])
        return model

    def partial(batches):
        total = np.zeros((FEATURES + 2, FEATURES + 1))
        for batch in batches:
            x = model.mapped(np.array(batch.column(0).to_pylist(), float).reshape(-1, d))
            total[:-1] += x.T @ x
            total[-1] += x.T @ np.array(batch.column(1).to_pylist(), float)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    def added(table: pa.Table) -> pa.Table:
        rows = np.array(table.column("row").to_pylist(), float)
        return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int32()), "row": pa.array([rows.sum(0)], pa.list_(pa.float64()))})

    schema = "i int, row array<double>"
    equations = fitting.select("stats", F.col("label").cast("double")).mapInArrow(partial, schema).groupBy("i").applyInArrow(added, schema).orderBy("i").collect()
    total = np.array([r["row"] for r in equations])
    model.beta = np.linalg.solve(total[:-1] + RIDGE * np.eye(FEATURES + 1), total[-1])

    def binned(batch: pa.RecordBatch):
        raw = model.raw(np.array(batch.column(0).to_pylist(), float).reshape(-1, d))
        yield {"bin": np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(int), "label": batch.column(1)}

    bins = mapped(calibrating.select("stats", F.col("label").cast("double").alias("label")), binned, "bin int, label double")
    found = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")).orderBy("bin").collect()
    model.edges = np.array([(r["bin"] + 0.5) * 3 / BINS - 1 for r in found])
    model.values = isotonic(np.array([r["n"] for r in found], float), np.array([r["s"] for r in found], float))
    return model


def training_rows(statistics: DataFrame, labels: DataFrame, modulus: int = 4) -> DataFrame:
    """(stats, label, calibrates) of the labelled documents outside the held-out fold; null labels teach nothing.

    A third of the documents, by a hash of the id, calibrates.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out("doc_id", modulus))
    known = known.select("doc_id", F.col("quality").cast("int").alias("label"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("calibrates"))
    return statistics.join(known, "doc_id").select("stats", "label", "calibrates")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, whose other columns are not read.

    Null and empty texts have the statistics zero and are scored like any other. Repeated rows get equal scores; a null
    doc_id is scored but never learnt from. Empty tables give an empty result, no labels a score of 0.5.
    """
    statistics = stored(document_statistics(docs))
    model = fit_quality(stored(training_rows(statistics, labels, modulus)))

    def over(batch: pa.RecordBatch):
        stats = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(STATISTICS))
        yield {"doc_id": batch.column(0), "score": model.scores(stats)}

    scored = mapped(statistics, over, "doc_id long, score double", 4096)
    return scored.select("doc_id", held_out("doc_id", modulus).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4) -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts: judged where they are read, without a join.

    Null and empty texts have the statistics zero and are judged like any other; repeated rows are judged alike; a null
    doc_id is judged but never learnt from. Without labels every score is 0.5. An empty table stays empty.
    """
    model = fit_quality(stored(training_rows(document_statistics(docs), labels, modulus)))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                stats = np.array([statistics_of(x) for x in part.column(at).to_pylist()]).reshape(-1, len(STATISTICS))
                yield part.filter(pa.array(model.scores(stats) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
