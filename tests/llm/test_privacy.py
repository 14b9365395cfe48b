"""Personal data against plain patterns, revealing terms against a brute-force version."""

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from loomwright.llm import privacy

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_spans_are_those_of_the_patterns():
    rng = random.Random(11)
    pieces = ["a", "b.", "@", "x@y.z", "-", "+", "4111 1111 1111 1111", "1.2.3.4", "256.", "0001", ".", " ", "(", ")", "5500-0000-0000-0004", "+1 (212) 555-0147", "é", "９", "7" * 20, "\n", "9" * 5]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert privacy.base_spans(text) == plain_spans(text), text
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 60_000, "1." * 60_000, "+1" * 60_000, "1 " * 60_000):
        privacy.base_spans(text)  # in linear time


def plain_terms(rows, removed=0.25, generalised=1.0, support=3, reach=8):
    """The definition, over all pairs."""
    with_term, witnesses, together = defaultdict(int), defaultdict(set), defaultdict(int)
    for _, text in rows:
        text = text or ""
        spans = plain_spans(text)
        clean = list(text)
        for _, a, b in spans:
            clean[a:b] = " " * (b - a)
        terms = [(m.start(), m[0].lower()) for m in re.finditer(r"(?<!\S)[^\s]*", "".join(clean))]
        terms = [(at + len(w) - len(re.sub(r"^[\W_]+", "", w)), re.sub(r"^[\W_]+|[\W_]+$", "", w)) for at, w in terms]
        terms = [t for t in terms if len(t[1]) > 2]
        words = [t[1] for t in terms]
        for term in set(words):
            with_term[term] += 1
        pairs = {}
        for kind, a, b in spans:
            before = [w for s, w in terms if s < a][-reach:]
            window = before + [w for s, w in terms if s >= a][:reach]
            for term in window:
                pairs.setdefault((privacy.entity(kind, text[a:b]), term), tuple(window))
        signs = privacy.signatures(words)
        for pair, window in pairs.items():
            together[pair] += 1
            witnesses[pair].add((window, *signs))
    out = {}
    for (who, term), n in together.items():
        if min(len(set(s)) for s in zip(*witnesses[who, term], strict=True)) >= support:
            left = -math.log2(n / with_term[term])
            if left <= generalised:
                out[term] = min(out.get(term, math.inf), left)
    return {t: "removed" if left <= removed else "generalised" for t, left in out.items()}


def letter_corpus():
    """A nickname and a half-revealing street stand by one address in documents of their own words; one is a near copy."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    words = [word() for _ in range(400)]
    rows = []
    for i in range(120):
        body = [rng.choice(words) for _ in range(60)]
        body[50:50] = [] if i < 9 else ["wrote", "from", "today"]
        if i < 9:
            body[30:30] = ["Zorro", "of", "Quaystreet", "wrote", "from", "Jo.Doe@mail.example.com" if i % 2 else "jo.doe@mail.example.com", "today"]
        elif i < 15:
            body[10] = "Quaystreet"
        elif i < 20:
            body[5] = "zorro" if i == 19 else "today"
        rows.append((i, " ".join(body)))
    base = [rng.choice(words) for _ in range(60)]
    for i in range(200, 230):  # near copies: one witness
        body = list(base)
        body[30:30] = ["Nearcopyterm", "+1 212 555 0147"]
        body[i % 25] = "changed"
        rows.append((i, " ".join(body)))
    return rows


def test_terms(spark):
    rows = letter_corpus()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = {r.term: r for r in privacy.revealing_terms(frame).collect()}
    assert {t: r.action for t, r in found.items()} == plain_terms(rows)
    assert found["zorro"].action == "removed" and found["quaystreet"].action == "generalised" and "nearcopyterm" not in found
    r = found["quaystreet"]
    assert math.isclose(r.bits_left, math.log2(15 / 9)) and math.isclose(r.information - r.disclosed, r.bits_left) and r.together == 9
    spans = privacy.private_spans(frame)
    out = {r.doc_id: r.clean for r in spans.withColumn("clean", privacy.sanitised()).collect()}
    assert " of [NAME] wrote from [EMAIL]" in out[0] and "zorro" not in out[19] and "Nearcopyterm [PHONE]" in out[200]
    terms = {r.doc_id: [s for s in r.spans if s.kind == "term"] for r in spans.collect()}
    assert all(rows[i][1][s.start : s.end].lower() in found for i, ss in terms.items() if i < 120 for s in ss) and len(terms[19]) == 1


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in privacy.digest(privacy.private_spans(docs)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        spans = plain_spans(text or "")
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in privacy.KINDS] == [sum(s[0] == k for s in spans) for k in privacy.KINDS]
        assert r.spans == base or r.spans.startswith(base)


def test_edges(spark):
    twice = "mail ab@c.de, ab@c.de or 1.2.3.4"
    rows = [(1, None), (None, ""), (2, twice), (2, twice), (3, "x" * 300_000 + "@a.b " + "1" * 300_000), (4, "😀 é 10.0.0.1 +4912345678")]
    frame = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, text string, spans string, hash int")
    got = privacy.private_spans(frame)
    assert sorted((r.doc_id or 0, len(r.spans)) for r in got.collect()) == [(0, 0), (1, 0), (2, 3), (2, 3), (3, 1), (4, 2)]
    clean = {r.doc_id: r.clean for r in got.select("doc_id", privacy.sanitised().alias("clean")).collect()}
    assert clean[2] == "mail [EMAIL], [EMAIL] or [IP]" and clean[4] == "😀 é [IP] [PHONE]" and clean[1] == ""
    assert privacy.private_spans(frame.limit(0)).collect() == []
    overlap = spark.createDataFrame([("0123456789", [("a", 2, 6, "<A>"), ("b", 4, 8, "<B>"), ("c", 9, 10, "")])], f"text string, spans {privacy.SPANS}")
    assert overlap.select(privacy.sanitised().alias("c")).first().c == "01<A>8"
    assert overlap.select(F.size("spans")).first()[0] == 3
