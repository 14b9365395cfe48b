"""Order statistics, phi-K, coherence and the index against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import coherence as co
from loomwright.operators import phik as pk
from loomwright.operators import retrieval as rt
from loomwright.operators import selection as sl
from loomwright.operators import vector_index as vi

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("few", [0, 20_000])
def test_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(sl, "FEW", few)
    rng = np.random.default_rng(2)
    columns = {"even": rng.random(30_000), "ties": rng.integers(0, 4, 25_000).astype(float), "long": rng.pareto(0.5, 21_001), "few": np.array([3.0, 1.0, 2.0, 10.0]), "one": np.array([7.0])}
    if few == 0:
        columns = {k: v for k, v in columns.items() if len(v) > 20_000}  # brackets hold the ranks beside a quartile for many rows only
    rows = [(k, float(x)) for k, values in columns.items() for x in values] + [("even", None), ("ties", float("nan"))]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "name string, x double").repartition(5)
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.name, r.probability): r.x for r in sl.exact_percentiles(frame, ["name"], "x", probabilities).collect()}
    assert len(got) == len(columns) * len(probabilities)
    for k, values in columns.items():
        for p in probabilities:
            assert got[k, p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12), (k, p)
    upper = {r.name: r.x for r in sl.exact_percentiles(frame, ["name"], "x", [0.5], upper=True).collect()}
    assert upper == {k: float(np.sort(v)[len(v) // 2]) for k, v in columns.items()}
    assert sl.exact_percentiles(frame.where("false"), [], "x", [0.5]).collect() == []


def dense(rho, rows, columns, m=300):
    """Cells of a bivariate normal by midpoints of a fine grid."""
    x, y = ((np.arange(n * m) + 0.5) * 10 / (n * m) - 5 for n in (rows, columns))
    z = np.exp(-(x[:, None] ** 2 - 2 * rho * x[:, None] * y + y**2) / (2 * (1 - rho * rho))) / (2 * np.pi * np.sqrt(1 - rho * rho))
    return (z * 100 / (rows * columns * m * m)).reshape(rows, m, columns, m).sum((1, 3))


@pytest.mark.parametrize("shape", [(10, 10), (3, 7), (2, 2)])
def test_phi_k_inverts_the_normal(shape):
    rows, columns = shape
    plain, n = dense(0.0, rows, columns), 50_000
    corner = np.zeros(shape)  # full correlation, whose cells are those that the diagonal crosses
    for k in range(200_000):
        z = (k + 0.5) / 200_000 * 10 - 5
        corner[int((z + 5) / 10 * rows), int((z + 5) / 10 * columns)] += np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * 10 / 200_000
    whole = (((corner - plain) ** 2) / plain).sum()
    pedestal, largest = (rows - 1) * (columns - 1), n * (min(shape) - 1)
    for rho in (0.1, 0.5, 0.8, 0.95):
        share = (((dense(rho, rows, columns) - plain) ** 2) / plain).sum() / whole
        assert pk.phi_k(pedestal + share * (largest - pedestal), n, rows, columns) == pytest.approx(rho, abs=1e-3)
    assert pk.phi_k(pedestal, n, rows, columns) == 0 and pk.phi_k(largest, n, rows, columns) == 1


def test_phi_k_near_full_correlation():
    """A chi-square just below its largest value costs no more than any other, and the way up to it is steady."""
    from time import monotonic

    began, largest = monotonic(), 1_200_000 * 9.0
    assert pk.phi_k(largest * (1 - 1e-12), 1_200_000, 10, 10) == pytest.approx(1, abs=1e-3)
    assert monotonic() - began < 10  # a quadrature of nodes by the correlation took minutes
    found = [pk.phi_k(largest * (1 - miss), 1_200_000, 10, 10) for miss in (0.1, 1e-2, 1e-3, 1e-4)]
    assert found == sorted(found) and 0.99 < found[0] and found[-1] < 1
    assert pk.independent(10, 10).sum() + pk.gained(1.0, 10, 10).sum() == pytest.approx(1 - 2 * 2.8665e-7, abs=1e-9)


def test_phi_k_pairs(spark):
    rng = np.random.default_rng(3)
    a, noise = rng.standard_normal(4000), rng.standard_normal(4000)
    rows = [(float(x), float(0.9 * x + 0.1 * e), float(e), "high" if x > 0 else "low", "same") for x, e in zip(a, noise)]
    got = {(r.column_a, r.column_b): r.phi_k for r in pk.phi_k_pairs(spark.createDataFrame(rows, "a double, b double, e double, side string, same string"), 0.0).collect()}
    assert got["a", "b"] > 0.95 and got["a", "side"] > 0.8 and got["a", "e"] < 0.15 and got["a", "same"] == 0
    assert pk.phi_k_pairs(spark.createDataFrame([], "a double, b double")).collect() == []


def plain_coherence(sentences, threshold, window=5, size=64):
    def vector(s):
        d = hashlib.sha256(s.encode()).digest()
        v = [(d[i % 32] - 128) / 128 for i in range(size)]
        v[0] = min(len(s) / 1000, 1)
        return np.array(v)

    v, n = [vector(s) for s in sentences], len(sentences)
    window = min(window, 3) if n > 20 else min(window, 5) if n > 10 else window
    means = [np.mean([v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) for j in range(max(0, i - window), i)]) for i in range(1, n)]
    if not means:
        return 1.0, 1.0
    m = float(np.mean(means))
    if threshold >= 0.6:
        return min(100, max(0, 100 * m)), m
    return (m / 0.3 * 50 if m < 0.3 else 50 + (m - 0.3) / 0.3 * 50 if m <= 0.6 else min(100, 100 * m)), m


def test_coherence(spark):
    rng = random.Random(9)
    texts = [[f"sentence {rng.randint(0, 3)}" for _ in range(n)] for n in (0, 1, 2, 5, 11, 12, 21, 40) for _ in range(4)]
    rows = [(i, t, 0.5 if i % 2 else 0.7) for i, t in enumerate(texts)] + [(100, None, 0.5)]
    frame = spark.createDataFrame(rows, "id int, s array<string>, t double").repartition(3)
    got = {r.id: r.c for r in frame.select("id", co.coherence_by_embeddings(F.col("s"), F.col("t")).alias("c")).collect()}
    for i, t, limit in rows[:-1]:
        score, mean = plain_coherence(t, limit)
        assert got[i].score == pytest.approx(score, abs=0.006) and got[i].similarity == pytest.approx(mean, abs=6e-5)
        assert got[i].sentences == len(t) and got[i].coherent == (mean >= limit)
    assert got[100].score == 1 and len(got) == len(rows)


def test_encoder_is_loaded_once_a_task(spark):
    made = spark.sparkContext.accumulator(0)

    def load():
        made.add(1)
        return co.hash_encoder(8)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    frame = spark.range(0, 200, 1, 2).select(F.array(F.col("id").cast("string"), F.lit("x")).alias("s"))
    frame.select(co.coherence_by_embeddings(F.col("s"), F.lit(0.6), load).alias("c")).write.format("noop").mode("overwrite").save()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert made.value == 2  # for twenty batches


def test_index_recall_and_exactness(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    points = e.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("v"), "label")
    queries = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = rt.nearest(queries, points, 10, -1.0)
    index = vi.build_index(points, str(tmp_path / "index"))
    lists = len(index.centroids)
    measured = vi.recall(vi.search(index, queries, 10, -(-lists // 2)), exact).first()
    print("recall", {p: round(vi.recall(vi.search(index, queries, 10, p), exact).first().recall, 4) for p in (lists // 4, lists // 3, lists // 2)})
    assert measured.queries == 100 and measured.recall >= 0.9
    again = vi.open_index(spark, str(tmp_path / "index"))
    full = vi.search(again, queries, 10, lists)
    key = lambda rows: {(r.query_id, r.rank): (r.point_id, round(r.score, 9)) for r in rows.collect()}
    assert key(full) == key(exact)
    some = vi.search(index, queries, 3, lists, "label = 2", 0.1).join(points, "point_id")
    assert some.where("label <> 2 or score < 0.1").isEmpty() and not some.isEmpty()


def test_index_edges(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [1.0, 2.0, 3.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (7, [0.0, 0.0])]
    points = spark.createDataFrame(rows, "point_id long, v array<double>")
    index = vi.build_index(points, str(tmp_path / "a"), lists=3)
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [1.0])], "query_id long, q array<double>")
    got = vi.search(index, queries, 10, 99).collect()
    assert [r.point_id for r in sorted(got, key=lambda r: r.rank)] == [1, 2, 6, 7] and {r.query_id for r in got} == {1}
    empty = vi.build_index(points.where("false"), str(tmp_path / "b"))
    assert vi.search(empty, queries, 3, 1).collect() == []
