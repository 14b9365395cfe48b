"""Whitening against fractions and numpy, and the exactness of residues."""

from fractions import Fraction

import numpy as np
import pytest

from loomwright.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, components=4):
    """The contract by whole numbers and fractions; eigh of the exactly rounded covariance."""
    usable = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    moved = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
    covariance = [[Fraction(sum(m[i] * m[j] for m in moved), n**3) for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array(covariance, float))
    order = np.argsort(-values)[:components]
    trace = float(sum(covariance[i][i] for i in range(d)))
    out = {}
    for i, x in usable:
        deviation = sum((n * x[j] - sums[j]) ** 2 for j in range(d))
        for k, o in enumerate(order):
            w = sum(float(Fraction(n * x[j] - sums[j], n)) * vectors[j, o] for j in range(d)) / np.sqrt(values[o])
            out[i, k + 1] = (n, deviation, w, values[o] / trace)
    return out


def vectors(scale=1.0, d=7, n=300):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((n, d)) * np.linspace(1, 3, d) + 40
    rows = [(i, (scale * v).tolist()) for i, v in enumerate(base)]
    return rows + [(1000 + i, rows[0][1]) for i in range(100)]  # copies count once


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_against_fractions(spark, scale):
    rows = vectors(scale)
    want = brute(rows)
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 7), (2004, [float("inf")] * 7)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    got = whitening.whiten(frame).collect()
    assert len(got) == len(want) == 4 * len(rows)
    sign = {k: np.sign(want[0, k][2] * next(r.whitened for r in got if (r.vec_id, r.component) == (0, k))) for k in range(1, 5)}
    for r in got:
        n, deviation, w, explained = want[r.vec_id, r.component]
        assert r.n == n and r.deviation == (deviation if deviation < 2**63 else None)
        assert r.whitened * sign[r.component] == pytest.approx(w, abs=1e-9)
        assert r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9


def test_edges(spark):
    run = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert run([]) == []
    single = run([(1, [0.5, -0.25, 1.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in single] == [(k, 1, 0, None, None, None) for k in (1, 2, 3)]
    flat = run([(i, [float(i), 2.0 * i]) for i in range(9)])  # all variance on one axis
    assert {r.whitened is None for r in flat if r.component == 2} == {True} and all(r.identity_error < 1e-9 for r in flat)
    mixed = run([(i, [float(i % 3), float(i // 3)]) for i in range(9)] + [(None, [float(i)]) for i in range(3)] + [(None, [1.0])])
    assert len(mixed) == 18 + 4 and {r.n for r in mixed if r.vec_id is None} == {3}
    assert len(run([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])])) == 6


def test_extra_columns_and_signs_of_zero(spark):
    rows = [(1, [0.0, 0.1], "x"), (2, [-0.0, 0.1], "y"), (3, [0.5, -0.1], "z"), (4, [0.2, 0.7], "z")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string").withColumn("n", whitening.F.lit(1))
    assert {r.n for r in whitening.whiten(frame).collect()} == {3}


def test_residues_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**62), 2**62, (5000, 3))
    bound = 5000 * (2**63) ** 2
    primes = whitening.primes_beyond(2 * bound)
    zero = np.zeros(3, np.int64)
    found = []
    for p in primes:
        total = np.zeros((3, 3), np.int64)
        for at in range(0, len(x), whitening.BLOCK):
            rest = whitening.centred(x[at : at + whitening.BLOCK], zero, p)
            total += (rest.T @ rest).astype(np.int64) % p
        found.append(total % p)
    whole = x.astype(object)
    assert (whitening.from_residues(found, primes) == whole.T @ whole).all()
