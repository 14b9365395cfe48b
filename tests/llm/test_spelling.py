"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

from loomwright.llm import spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, often=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= often}
    out = {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_apart(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 5 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    roots = {}
    for w in words:
        root = w
        while out[root][0]:
            root = out[root][0]
        roots[w] = root
    return {w: (f, roots[w], n, k, m) for w, (f, n, k, m) in out.items()}


def found(frame, **options):
    rows = spelling.spelling_variants(frame, **options).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = found(docs)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()]) and len(got) > 500


def test_chains_anagrams_and_runs(spark):
    rng = random.Random(3)
    texts = []
    for base, n in (("letters", 700), ("lettters", 130), ("letterss", 24), ("lettres", 9), ("aabbaabb", 40), ("aabbaab", 8), ("Étoiles", 60), ("Étoilee", 9), ("sixsix", 5)):
        texts += [base] * n
    pool = ["".join(rng.choice("ab") for _ in range(rng.choice([6, 7, 8]))) for _ in range(150)]
    texts += [w for w in pool for _ in range(rng.choice([5, 6, 30, 160]))]
    rng.shuffle(texts)
    rows = [(i, " ".join(texts[i * 40 : i * 40 + 40])) for i in range(len(texts) // 40 + 1)]
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert got == brute(rows)
    assert got["letterss"][1] == "letters" and any(f and got[f][0] for f, *_ in got.values())


def test_edges(spark):
    long = "xy" * 3000
    rows = [(None, "plainly Plainly PLAINLY"), (None, "plainly-plainly_plainly"), (1, None), (2, ""), (3, "plain ×plain")]
    rows += [(4 + i, f"{long} {long}z " + "a" * 50 + " " + "a" * 49) for i in range(6)]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, word string, n int")
    assert found(frame) == brute(rows)
    assert found(frame.limit(0)) == {}


def test_slices_cut_no_word():
    text = " ".join(["wordés", "中", "other"] * 50)
    parts = list(spelling.slices(text, 7))
    assert "".join(parts) == text and len(parts) > 20 and all(not p[-1].isalpha() or p[-1] == "中" for p in parts[:-1])
