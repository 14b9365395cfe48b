"""The quality classifier: ridge and isotonic steps against brute force, folds, accuracy, edge cases."""

import random
import zlib

import numpy as np
import pytest
from loomwright.llm import quality


def documents(n=400):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90))).capitalize() + "."
    bad = lambda: " ".join(rng.choice(["###", "BUY NOW!!", "$$$", "x|y|z", "click", "0000"]) for _ in range(rng.randint(5, 60)))
    docs = [(i, good() if i % 3 else bad()) for i in range(n)]
    return docs, [(i, int(i % 3 > 0)) for i in range(0, n, 2)]


def test_ridge_and_isotonic_against_brute_force(spark):
    docs, labels = documents()
    label = dict(labels)
    stats = np.array([quality.statistics_of(t) for d, t in docs if d in label])
    y = np.array([label[d] for d, _ in docs if d in label], float)
    calibrates = np.arange(len(y)) % 3 == 0
    rows = spark.createDataFrame([(s.tolist(), int(v), bool(c)) for s, v, c in zip(stats, y, calibrates)], "stats array<double>, label int, calibrates boolean")
    model = quality.fit_quality(rows.repartition(5))
    assert model.mean == pytest.approx(stats.mean(0)) and model.scale == pytest.approx(np.where(stats.std(0) > 1e-9, stats.std(0), 1))
    x = model.mapped(stats[~calibrates])
    want = np.linalg.solve(x.T @ x + quality.RIDGE * np.eye(x.shape[1]), x.T @ y[~calibrates])
    assert model.beta == pytest.approx(want, abs=1e-8)
    assert (np.diff(model.values) >= 0).all() and len(model.edges) == len(model.values)
    raw = model.raw(stats[calibrates])
    bins = np.clip(np.floor((raw + 1) / 3 * quality.BINS), 0, quality.BINS - 1).astype(int)
    sums = {b: (y[calibrates][bins == b].sum(), (bins == b).sum()) for b in sorted(set(bins.tolist()))}
    assert model.edges == pytest.approx([(b + 0.5) * 3 / quality.BINS - 1 for b in sums])
    assert model.values == pytest.approx(brute_isotonic([s / n for s, n in sums.values()], [n for _, n in sums.values()]))


def brute_isotonic(values, weights):
    """max over starts of the min over ends of the weighted mean of the values between."""
    mean = lambda a, b: np.average(values[a : b + 1], weights=weights[a : b + 1])
    n = len(values)
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_pools_adjacent_violators():
    rng = np.random.default_rng(1)
    counts, share = rng.integers(1, 9, 60).astype(float), rng.random(60)
    assert quality.isotonic(counts, counts * share) == pytest.approx(brute_isotonic(share.tolist(), counts.tolist()))


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_fold(spark):
    docs, labels = documents()
    rows = {r.doc_id: r for r in quality.score_quality(*frames(spark, docs, labels)).collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [d for d in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in rows.items() if r.held_out} == set(held)
    assert np.mean([rows[d].predicted == (d % 3 > 0) for d in held]) > 0.95
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q) for d, q in labels]
    again = {r.doc_id: r.score for r in quality.score_quality(*frames(spark, docs, flipped)).collect()}
    assert again == pytest.approx({d: r.score for d, r in rows.items()}, abs=1e-9)


def test_sample_data_is_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_odd_tables(spark):
    docs, labels = documents(60)
    odd = [(None, "a text"), (1000, None), (1001, ""), (1002, "w " * 50_000), (3, docs[3][1]), (3, docs[3][1])]
    frame = spark.createDataFrame([(d, t, 1, 0.0) for d, t in docs + odd], "doc_id long, text string, label int, score double")
    known = spark.createDataFrame([*labels, (4, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score_quality(frame, known).collect()
    assert len(rows) == 66 and len({r.score for r in rows if r.doc_id == 3}) == 1 and len({r.score for r in rows if r.doc_id in (1000, 1001)}) == 1
    kept = quality.keep_quality(frame, known)
    accepted = sum(r.predicted for r in rows)
    assert kept.columns == frame.columns and kept.count() == accepted
    assert {r.score for r in quality.score_quality(frame, known.where("false")).collect()} == {0.5}
    assert quality.score_quality(frame.where("false"), known).collect() == [] and quality.keep_quality(frame.where("false"), known).collect() == []
