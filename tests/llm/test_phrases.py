"""Removal of repeated passages against a brute-force version."""

import hashlib
import random

from loomwright.llm import phrases


def brute(docs, size=20):
    seen, out = {}, {}
    for doc_id, text in sorted(docs):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for at in range(len(words) - size + 1):
            if seen.setdefault(b" ".join(words[at : at + size]), (doc_id, at)) != (doc_id, at):
                gone[at : at + size] = [True] * size
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "à"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, line = text(60), text(25)
    docs = [(i, " ".join(text(rng.randint(1, 200)))) for i in range(40)]
    docs += [(100 + i, " ".join(text(30) + passage[i % 7 : 60 - i % 5] + text(30))) for i in range(12)]
    docs += [(200 + i, " ".join(line * 4)) for i in range(3)]
    docs += [(300 + i, docs[3][1]) for i in range(5)] + [(5000, "x " * 500), (2, "clash"), (400, None), (401, ""), (402, " \n\t "), (403, "w1 w2 \x1c w3")]
    near = docs[20][1].split()
    docs += [(500 + i, "\n".join(near[:i] + ["edit"] + near[i + 1 :])) for i in range(0, len(near), 9)]
    docs += [(-4, " ".join(passage))]
    return [d for d in docs if d[0] != 2]


def test_against_brute_force(spark):
    docs = corpus()
    want = brute(docs)
    rows = phrases.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
    assert got == want
    for r in rows:
        if r.kept_text is not None:
            assert hashlib.sha256(b" ".join(r.kept_text.encode().split())).hexdigest() == r.kept_sha256


def test_odd_rows(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = [(None, text, 1), (7, text, 2), (7, text, 2), (8, "short", 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    got = {(r.doc_id, r.n_words, r.n_removed) for r in phrases.remove_repeats(frame).collect()}
    assert got == {(None, 30, 0), (7, 30, 30), (8, 1, 0)}
    assert phrases.remove_repeats(frame.where("false")).collect() == []


def test_hashes_of_words():
    text = "a ab \t ba\n\n aab é \x1c a ab " + "x" * 90
    got, words = phrases.hashed(text), text.encode().split()
    assert len(got) == len(words) and len(set(got.tolist())) == len(set(words))
    assert phrases.hashed("ab").tolist() == got[[1]].tolist()
    assert len(phrases.hashed(None)) == len(phrases.hashed(" \n")) == 0
    whole, phrases.PIECE = phrases.hashed(text * 30).tolist(), 50
    try:
        assert phrases.hashed(text * 30).tolist() == whole
    finally:
        phrases.PIECE = 1 << 22
