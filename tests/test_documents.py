"""From documents to chunks: settings and chunkers against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomwright.operators import chunkers as ck
from loomwright.operators import document_pipeline as dp

SF = "/root/testdata/sf0.001"


def tokens(s):
    return max(len(s) // 4, len(s.split()))


def plain_words(text, room, overlap):
    out, line = [], []
    for word in text.split():
        if line and sum(len(w) + 1 for w in line) + len(word) + 1 > 4 * room:
            out.append(" ".join(line))
            kept = []
            while overlap > 0 and len(kept) < len(line) and sum(len(w) + 1 for w in [line[-1 - len(kept)], *kept]) <= overlap:
                kept = [line[-1 - len(kept)], *kept]
            line = kept
        line.append(word)
    return [*out, " ".join(line)] if line else [text]


def plain_sentences(text, room, keep, overlap):
    parts = [p.strip() for p in re.split(r"(?<!\b[A-Z])[.!?。۔؟]+(?=\s+[A-Z0-9\"'])", text) if p.strip()]
    if not parts:
        return plain_windows(text, room, overlap)
    found, line = [], []
    for part in parts:
        if tokens(part) > room:
            if line:
                found.append(" ".join(line))
            pieces = plain_words(part, room, overlap)
            found.extend(pieces)
            line = [pieces[-1]] if keep > 0 else []
        elif tokens(" ".join(line + [part])) <= room:
            line = line + [part]
        else:
            if line:
                found.append(" ".join(line))
            line = (line[-keep:] if keep > 0 else []) + [part]
    if line:
        found.append(" ".join(line))
    return [p for f in found for p in (plain_words(f, room, overlap) if tokens(f) > room else [f])]


def plain_windows(text, room, overlap):
    out, at = [], 0
    while at < len(text):
        piece = text[at : at + 4 * room].strip()
        if piece:
            out.append(piece)
        if at + 4 * room >= len(text):
            break
        at = max(at + 4 * room - overlap, at + 1)
    return out


def plain_paragraphs(text, room, keep, overlap):
    parts = [p.strip() for p in re.split(r"\n\s*\n+", text) if p.strip()]
    if not parts:
        return []
    if len(parts) <= 1 or all(len(p) < 50 for p in parts):
        other, group, last = [], [], None
        for line in text.split("\n"):
            if not line.strip():
                other += [group] if group else []
                group = []
                continue
            depth = len(line) - len(line.lstrip())
            if last is not None and abs(depth - last) > 2 and group:
                other.append(group)
                group = []
            group = group + [line.strip()]
            last = depth
        other += [group] if group else []
        if len(other) > len(parts):
            parts = ["\n".join(g) for g in other]
    if len(parts) == 1 and tokens(parts[0]) > 2 * room:
        return plain_sentences(text, room, max(1, keep * 2), overlap)
    found, held = [], []
    for part in parts:
        if tokens(part) > room:
            if held:
                found.append("\n\n".join(held))
            held = []
            found.extend(plain_sentences(part, room, max(1, keep * 2), overlap))
        elif tokens("\n\n".join(held + [part])) <= room:
            held = held + [part]
        else:
            if held:
                found.append("\n\n".join(held))
            held = (held[-keep:] if keep > 0 else []) + [part]
    if held:
        found.append("\n\n".join(held))
    return [p for f in found for p in (plain_sentences(f, room, max(1, keep * 2), overlap) if tokens(f) > room else [f])]


def plain_chunk(text, strategy, room, keep, overlap):
    if strategy == "char":
        return plain_windows(text, room, overlap) or [text]
    if strategy == "paragraph":
        return plain_paragraphs(text, room, max(1, keep // 2), overlap) or [text]
    return plain_sentences(text, room, keep, overlap) or [text]


def test_chunkers():
    rng = random.Random(4)
    pieces = ["Word", "another", "x" * 30, ". Next", "! 4", "\n\n", "\n    deep", "\nline", " ", "", "A. B", "é", "\n \n\n"]
    for _ in range(3000):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))
        for strategy in ("char", "sentence", "paragraph"):
            room, keep, overlap = rng.choice([3, 8, 20, 60]), rng.choice([0, 1, 2, 5]), rng.choice([0, 4, 30])
            assert ck.chunk(text, strategy, room, keep, overlap) == plain_chunk(text, strategy, room, keep, overlap), (text, strategy, room, keep, overlap)


GIVEN = ["mode", "manual_size", "manual_overlap", "manual_strategy", "resolved_size", "resolved_overlap", "resolved_strategy", "resolved_kind", "resolved_confidence", "threshold", "playbook"]


@pytest.mark.parametrize("given,want", [
    ({"mode": "manual", "playbook": "tech"}, ("manual", "sentence", 800, 200, 800, 10, 800)),
    ({"mode": "manual", "manual_size": 300, "manual_overlap": 10, "manual_strategy": "Semantic", "playbook": "legal"}, ("manual", "paragraph", 300, 10, 300, 1, 40)),
    ({"mode": "auto", "resolved_size": 500, "resolved_overlap": 100, "resolved_strategy": "recursive", "resolved_confidence": 0.8}, ("product_auto", "sentence", 500, 100, 500, 5, 400)),
    ({"resolved_size": 500, "resolved_overlap": 100, "resolved_strategy": "semantic", "resolved_confidence": 0.6}, ("product_auto", "char", 500, 100, 500, 5, 400)),
    ({"resolved_size": 500, "resolved_strategy": "semantic", "resolved_confidence": 0.6, "threshold": 0.5}, ("product_auto", "paragraph", 500, 200, 500, 10, 800)),
    ({"resolved_size": 0, "resolved_overlap": -4, "manual_size": 50, "manual_overlap": 60}, ("product_auto", "char", 50, 49, 50, 2, 196)),
    ({"resolved_size": 20_000, "resolved_overlap": 0, "resolved_strategy": ""}, ("product_auto", "char", 20_000, 0, 4000, 1, 300)),
    ({"mode": "none", "playbook": "Re-Gulatory"}, ("playbook_default", "sentence", 900, 40, 900, 2, 300)),
])
def test_settings(spark, given, want):
    kinds = [f"{n} {dp.GIVEN[n]}" for n in GIVEN]
    frame = spark.createDataFrame([tuple(given.get(n) for n in GIVEN) + ("Three short words.", None)], ", ".join(kinds) + ", text string, extension string")
    s = dp.resolved_settings(frame).first().settings
    assert (s.source, s.strategy, s.size, s.overlap, s.tokens, s.sentences, s.characters) == want


def test_detected_settings(spark):
    """Nothing is said of the settings: a playbook hints at a kind, else the text alone tells it; few words, few tokens."""
    rows = [(1, "auto", "retail"), (2, None, None), (3, "auto", "legal")]
    frame = spark.createDataFrame(rows, "doc_id long, mode string, playbook string").withColumns({n: F.lit(None).cast(k) for n, k in dp.GIVEN.items() if n not in ("mode", "playbook")}).withColumn("text", F.lit("Three short words."))
    got = {r.doc_id: r.settings for r in dp.resolved_settings(frame).collect()}
    assert (got[1].source, got[1].strategy, got[1].kind, got[1].confidence, got[1].size, got[1].overlap) == ("product_auto", "char", "general", 0.3, 100, 3)
    assert (got[2].kind, got[2].strategy) == ("general", "char")
    assert (got[3].kind, got[3].strategy, got[3].confidence, got[3].size) == ("legal", "paragraph", 0.6, 200)


def test_records(spark):
    from loomwright.plans import document_queries as dq

    docs = dq.given(spark, SF)
    sections = dp.sections_of(docs).collect()
    want = {}
    for r in sections:
        s = r.settings
        for i, chunk in enumerate(plain_chunk(r.body, s.strategy, s.tokens, s.sentences, s.characters)):
            want.setdefault((r.doc_id, r.page, r.title), []).append(chunk)
    got = {}
    for r in dp.chunk_records(docs).orderBy("doc_id", "page", "chunk_index").collect():
        got.setdefault((r.doc_id, r.page, r.section_raw), []).append(r.text)
        assert r.token_est == tokens(r.text) and r.chunk_index < r.chunk_of and r.chunk_id.startswith(r.document_id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(got) > 150
    assert {r.settings.source for r in sections} == {"manual", "product_auto", "playbook_default"}
    assert {r.settings.strategy for r in sections} == {"char", "sentence", "paragraph", "fixed_size"}  # a playbook's own name counts as sentences


def test_odd_documents(spark):
    rows = [(1, "a", None), (2, "b", ""), (3, "c", " \n "), (4, "d", "=== PAGE 1 ===\nOne line here.\n=== PAGE 2 ===\n"), (5, "e", "x" * 50_000), (5, "e", "x" * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id long, stem string, text string").withColumn("page", F.lit("extra"))
    got = dp.chunk_records(frame).collect()
    assert {r.doc_id for r in got} == {4, 5} and [r.page for r in got if r.doc_id == 4] == [1]
    whole = [r.text for r in got if r.doc_id == 5]
    assert len(whole) % 2 == 0 and dp.chunk_records(frame.limit(0)).collect() == []
    stats = {r.doc_id: r for r in dp.document_stats(dp.chunk_records(frame)).collect()}
    assert stats[5].chunks == len(whole)
    assert all(0 <= r.AI_Trust_Score <= 100 for r in dp.scored_chunks(dp.chunk_records(frame)).collect())
