"""Embedding links and exact search against brute force."""

import numpy as np

from loomwright.llm import embed_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(7)
    base = rng.standard_normal((30, 16)).astype(np.float32)
    rows = []
    for i in range(400):
        v = base[i % 30] + rng.standard_normal(16).astype(np.float32) * rng.choice([0, 0.05, 0.25, 0.6])
        rows.append((i + 1, v.tolist(), int(i % 4)))
    rows += [(1000, None, 1), (1050, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1100, [float("inf")] + [0.0] * 15, 1), (1004, [None] * 16, 1)]
    rows += [(1005, rows[3][1], None), (1150, [1.0, 2.0], 1), (1200, [1.0, 2.1], 1), (1008, [], 1), (-50, rows[7][1], 3)]
    return rows


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows, threshold=0.93):
    ids, links = [r[0] for r in rows], {r[0]: set() for r in rows}
    for a, v, x in rows:
        for b, w, y in rows:
            if a < b and x is not None and x == y and usable(v) and usable(w) and len(v) == len(w) and any(v) and any(w):
                v64, w64 = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if (v64 * w64).sum() / (np.linalg.norm(v64) * np.linalg.norm(w64)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    component = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            least = min([component[a], *(component[b] for b in links[a])])
            changed |= least != component[a]
            component[a] = least
    return {i: (len(links[i]), component[i], component[i] == i) for i in ids}


def test_links(spark):
    rows = vectors()
    want = brute_links(rows)
    for tile in (2048, 25):
        got = embed_dedup.linked_vectors(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def test_error_bound_is_rigorous():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 24))
    units = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embed_dedup.quantised(units)
    close = (q @ q.T) * s[:, None] * s[None, :]
    assert (np.abs(units @ units.T - close) <= (1 + e[:, None]) * e[None, :] + e[:, None] + 1e-9).all()


def test_repeated_rows_and_empty(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], SCHEMA).selectExpr("*", "1 AS node")
    got = sorted((r.vec_id or 0, r.n_links) for r in embed_dedup.linked_vectors(frame).collect())
    assert got == [(0, 0), (1, 1), (1, 1)]
    assert embed_dedup.linked_vectors(frame.where("false")).collect() == []
    assert topk.top_k(frame.where("false")).collect() == []


def test_top_k(spark):
    rows = vectors()
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if usable(v)}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        found = sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q and len(w) == len(whole[q]))
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(found[:5], 1)}
    for pivots, sample in ((24, 4096), (3, 40), (1, 1)):
        got = topk.top_k(spark.createDataFrame(rows, SCHEMA), pivots=pivots, sample=sample).drop("evaluated").collect()
        assert set(map(tuple, got)) == want and len(got) == len(want)


def test_top_k_blocks_copies_and_clashing_names(spark, monkeypatch):
    rng = np.random.default_rng(8)
    copy = rng.standard_normal(12)
    rows = [(i, (copy if i % 3 == 0 else rng.standard_normal(12)).tolist(), i % 7, "x", -1) for i in range(900)]
    rows += [(0, rows[0][1], 9, "y", -1), (7, rows[7][1], 9, "y", -1)]  # a repeated query and a repeated candidate
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 5)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int, score string, floor int")
    got = {}
    for r in topk.top_k(frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, *_ in rows]
    first = dict(reversed(whole))
    assert set(got) == {i for i in first if i % 50 == 0}
    for q, found in got.items():
        best = sorted((-int(first[q] @ w), i) for i, w in whole if i != q)[:5]
        assert sorted(found) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_pivots_eliminate_rows(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((4000, 64))
    rows = [(i, (x / np.linalg.norm(x)).tolist(), 0) for i, x in enumerate(v)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA)).where("rank = 1").collect()
    assert len(got) == 80 and sum(r.evaluated for r in got) < 0.25 * 80 * 4000


def test_bounds_hold():
    rng = np.random.default_rng(6)
    for width, n in ((64, 40), (8, 8), (3, 200)):
        x = np.floor(256 * rng.standard_normal((n, width)))
        x[: n // 4] = x[0]
        pivots = topk.Pivots.of(x, np.arange(n), 3 * width // 4 + 1).prepare()
        feet, square = pivots.feet(pivots.distances(x)), (x * x).sum(1)
        limit = topk.bounds(feet, feet, square, square)
        assert (limit >= x @ x.T).all()
        single = (square[:, None] + square - np.abs(pivots.distances(x)[:, None] - pivots.distances(x)[None]).max(2) ** 2) / 2
        assert (limit <= single + 1e-4 * square.max()).all()
