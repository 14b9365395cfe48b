"""Near-duplicate groups and the pipeline's stages against brute force."""

import random

import corpus_pipeline
from loomwright.llm import phrases, simhash


def sets(text, size=5):
    words = [w.lower() for w in (text or "").encode().split()]
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} or ({b" ".join(words)} if words else set())


def brute_groups(docs, similarity=0.8):
    shingles = {d: sets(t) for d, t in docs}
    component = {d: d for d in shingles}
    alike = lambda a, b: len(a & b) >= similarity * len(a | b)
    links = [(a, b) for a in shingles for b in shingles if a < b and alike(shingles[a], shingles[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if component[a] != component[b]:
                component[a] = component[b] = min(component[a], component[b])
                changed = True
    return component


def near_documents():
    rng = random.Random(9)
    base = [[f"Word{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 250))] for _ in range(30)]
    docs = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "edit"
        docs.append((100 + i, " ".join(words)))
    hub = base[0] * 2
    for i in range(80):
        words = list(hub)
        words[rng.randrange(len(words))] = f"x{i}"
        docs.append((400 + i, " ".join(words)))
    return docs + [(600, ""), (601, None), (602, "one"), (603, "One"), (604, "two")]


def test_similar_groups(spark):
    docs = near_documents()
    want = brute_groups(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()}
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert got == {d: c for d, c in want.items() if sizes[c] > 1}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame).collect()}
    assert kept == {d for d, c in want.items() if d == c}


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shape = docs.schema.simpleString()
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert kept.schema.simpleString() == shape and 0 < kept.count() < docs.count()
    near = corpus_pipeline.simhash_stage(spark, docs, sf)
    assert near.schema.simpleString() == shape
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in near.collect()} == {d for d, c in want.items() if d == c}
    cut = corpus_pipeline.substring_stage(spark, docs, sf)
    assert cut.schema.simpleString() == shape
    removed = {r.doc_id: r for r in phrases.remove_repeats(docs).collect()}
    for r in cut.collect():
        assert len(r.text.split()) == removed[r.doc_id].n_words - removed[r.doc_id].n_removed and r.n_chars == len(r.text)


def test_whole_pipeline(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id", "length"} <= set(rows[0].asDict())


def test_groups_come_from_the_grid_of_fingerprints(spark, monkeypatch):
    """Texts within 3 bits meet in the grid and are verified, whatever the prefixes find; equal bits alone are no link."""
    monkeypatch.setattr(simhash, "prefix", lambda shingles, *_: shingles[:0])
    rng = random.Random(3)
    docs = []
    for base in range(6):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(600)]
        docs += [(base * 10 + i, " ".join([*words[: 600 - i], *(f"e{i}" for _ in range(i))])) for i in range(5)]
    docs += [(100, "a b c d e f g h i " * 50), (101, "a b c d e f g h i " * 50 + "and one more line that only this text has got at its end")]
    prints = {d: simhash.fingerprint(simhash.shingle_hashes(t, 5)) for d, t in docs}
    near = [(a, b) for a, _ in docs for b, _ in docs if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    alike = [(a, b) for a, b in near if len(sets(dict(docs)[a]) & sets(dict(docs)[b])) >= 0.8 * len(sets(dict(docs)[a]) | sets(dict(docs)[b]))]
    assert len(alike) > 10 and (100, 101) in near and (100, 101) not in alike
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got.keys() == {d for pair in alike for d in pair} and all(got[a] == got[b] for a, b in alike)
