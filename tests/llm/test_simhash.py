"""Fingerprints and components against brute force."""

import random

import numpy as np
import xxhash

from loomwright.llm import common, simhash


def brute_print(text, size=3):
    words = [w.lower() for w in (text or "").encode().split()]
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=3):
    component = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, x in rows:
            for b, y in rows:
                if bin(x ^ y).count("1") <= radius and component[a] != component[b]:
                    component[a] = component[b] = min(component[a], component[b])
                    changed = True
    return component


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(f"Word{rng.randint(0, 400)}" for _ in range(120)) for _ in range(15)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "edit"
        docs.append((100 + i, " ".join(words)))
    docs += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE"), (305, "one two"), (306, "é É")]
    want = {d: brute_print(t) for d, t in docs}
    component = brute_components(list(want.items()))
    rows = simhash.simhash_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{f:016x}", component[d]) for d, f in want.items()}


def test_large_cell_keeps_components():
    rng = np.random.default_rng(1)
    fps = np.unique(np.uint64(12345678901) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    assert len(fps) > simhash.LARGE
    assert sum(map(len, simhash.links_within(fps, 3))) == len(fps) - 1


def test_empty_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "y")], "doc_id long, text string, fp string")
    rows = simhash.simhash_components(frame).collect()
    assert [r.component_id for r in rows] == [1, 1, 1]
    assert simhash.simhash_components(frame.where("false")).collect() == []


def test_similar_texts_that_repeat_a_line_differently(spark):
    rng = random.Random(5)
    docs = []
    while len(docs) < 20:
        words, line = ([f"w{rng.randint(0, 10**6)}" for _ in range(n)] for n in (150, 8))
        pair = [" ".join(line * 2 + words), " ".join(line * 40 + words[:-1] + ["edit"])]
        a, b = (simhash.shingle_hashes(t, 5) for t in pair)
        assert 0.8 * len(np.union1d(a, b)) <= len(np.intersect1d(a, b)) < len(np.union1d(a, b))
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 20:
            docs += enumerate(pair, len(docs))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in docs}


def test_order_of_shingles_changes_no_result(spark, monkeypatch):
    rng = random.Random(6)
    line = [f"l{i}" for i in range(30)]
    base = [[f"w{rng.randint(0, 10**6)}" for _ in range(60)] for _ in range(40)]
    docs = []
    for i in range(200):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"e{i}"
        docs.append((i, " ".join(line + words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted(simhash.similar_groups(frame).collect())
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    assert len(simhash.common_shingles(frame, 5)[0]) >= 26
    assert sorted(simhash.similar_groups(frame).collect()) == plain


def test_crowd_with_links_beyond_the_forest(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(110)]
    docs = []
    for i in range(100):  # about 0.8 similar, with repeats that move the fingerprints apart or together
        words = list(base)
        for at in rng.sample(range(5, 105, 10), 3):
            words[at] = f"e{rng.randint(0, 2)}"
        docs.append((i, " ".join(words + [f"r{rng.randint(0, 3)}"] * rng.choice([1, 60, 120]))))
    sets = {d: {*simhash.shingle_hashes(t, 5).tolist()} for d, t in docs}
    member = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            member[b] = min(member[a], member[b])
    assert len({*member.values()}) > 1
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: c for d, c in member.items() if [*member.values()].count(c) > 1}


def test_parity_and_pairs_between_components():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(2))
    b = np.unique(np.concatenate([a[:190], b[:10]]))
    bits = np.frombuffer(simhash.parity(a) + simhash.parity(b), np.uint64).reshape(2, 16)
    assert 0 < np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))
    n = 40
    keys, at, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, 200)
    found = simhash.cross_pairs(keys, np.arange(n), np.arange(n) % 2, sizes, at, np.repeat(bits[:1], n, 0), 0.8)
    pairs = {tuple(sorted(p)) for x, y in found for p in zip(x.tolist(), y.tolist())}
    assert pairs == {(i, j) for i in range(n) for j in range(i + 1, n) if i % 2 != j % 2}


def test_tiles_bound_a_place_and_bring_all_rows_together(spark):
    frame = spark.createDataFrame([(k, i) for k, n in ((1, 900), (2, 90), (3, 3)) for i in range(n)], "key long, row long")
    places = {}
    for r in common.tiled(frame, "key", "row", 100).collect():
        places.setdefault(r.place, []).append((r.key, r.row))
    assert max(map(len, places.values())) < 300 and len(places[2]) == 90 and len(places[3]) == 3
    met = {(a, b) for p in places.values() if p[0][0] == 1 for _, a in p for _, b in p}
    assert len(met) == 900 * 900


def test_tiled_cells_keep_components(spark, monkeypatch):
    rng = np.random.default_rng(1)
    bits = lambda: np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)
    fps = np.unique(np.uint64(12345678901) ^ bits() ^ bits())
    monkeypatch.setattr(common.tiled, "__defaults__", (50,))
    links = simhash.grid_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    labels, place = np.arange(len(fps)), {int(x): i for i, x in enumerate(fps.view(np.int64))}
    common.join_trees(labels, np.array([place[r.a] for r in links]), np.array([place[r.b] for r in links]))
    whole = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    common.join_trees(whole, i, j)
    assert (labels == whole).all()
