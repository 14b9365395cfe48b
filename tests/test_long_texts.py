"""Long and odd texts: runs that overflowed Java's matcher or were tried again and again, and forms that spare work."""

import random
import re
from time import monotonic

import pytest
from pyspark.sql import functions as F

from loomwright.functions import scores as sc
from loomwright.functions import text as tx
from loomwright.operators import document_pipeline as dp

N = 20_000


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text")).alias("v")).first().v


def test_runs_of_capitalised_words(spark):
    """A repeated group recursed for every word and ended the executor."""
    assert one(spark, "Abcd " * N, sc.context_quality) == 40 + 10 + 10
    title, *rest = one(spark, "Abcd " * N + "\nbody", tx.sections)
    assert (len(title.title), title.body, rest) == (5 * N - 1, "body", [])
    frame = spark.createDataFrame([(1, "a", "Abcd " * N + "\n" + "Some text. " * 30)], "doc_id long, stem string, text string")
    assert dp.document_stats(dp.chunk_records(frame)).first().chunks >= 1


def test_texts_are_cut_once(spark):
    frame = spark.createDataFrame([(1, "a", "One. Two.")], "doc_id long, stem string, text string")
    plan = dp.document_stats(dp.chunk_records(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_runs_in_metadata(spark):
    found = one(spark, "Author: " + "abcd " * N + ". v1" + ".1" * N, lambda c: tx.found_metadata(c, F.lit("")))
    assert found.tags == "author:" + ("abcd " * N).strip() + "; versions:1" + ".1" * N


def test_runs_of_blanks(spark):
    began = monotonic()
    assert one(spark, " a" + " " * 100_000 + "b ", tx.stripped) == "a" + " " * 100_000 + "b"
    assert len(one(spark, "1. One" + " " * 100_000 + "two\nx", tx.sections)) == 1
    assert monotonic() - began < 30  # over a minute before


@pytest.mark.parametrize("kept,plain", [
    (tx.TITLE_CASE, r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+$"), (tx.VERSION, r"(?i)\b(v|version|ver|v\.)\s*(\d+(?:\.\d+)+)\b"),
    (tx.AUTHOR, r"(?i)(?:By|Author|Written by|Created by):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"),
])
def test_patterns_match_as_before(spark, kept, plain):
    rng = random.Random(5)
    parts = ["Ab", "a", "Abc", " ", "  ", "\n", "By:", "author: ", "v", "1", "12", ".", ".3", "4a", "_", "v. ", "version", "É", "x9"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", found(kept).alias("a"), found(plain).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and any(r.a for r in rows)


def test_forms_that_spare_work(spark):
    rng = random.Random(6)
    parts = ["word", " ", "\n", "\n\n", "\r\n", "\t", ". ", "End. Next", "-\n", "a-\nb", "x@y.com", "555-123-4567", "123 45 6789", "  ", "\u00a0", "=== PAGE 2 ===", "===", "the contract", "API", "\ncode = f(x)", "\n# T", "[a](b)", "Index\n", "\n page 1 of 2\n", "é"]
    texts = ["", " ", "\n", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(1500))]
    t = F.col("t")
    plain = by_patterns(t)
    mine = [tx.word_count(t), tx.redact_pii(t), tx.has_pii(t), tx.unwrapped(t), tx.stripped(t), sc.mean_sentence(t)]
    frame = spark.createDataFrame([(x,) for x in [*texts, None]], "t string")
    for r in frame.select("t", F.struct(*[c.alias(f"c{k}") for k, c in enumerate(mine)]).alias("a"), F.struct(*[c.alias(f"c{k}") for k, c in enumerate(plain)]).alias("b"), tx.pages(t).alias("pages"), sc.noise_percent(t).alias("noise")).collect():
        assert r.a == r.b, r.t
        marks = re.findall(r"===\s*PAGE\s+(\d+)\s*===", r.t or "")
        assert len(r.pages) == max(len(marks), 1)
        taken = []
        for p in sc.NOISE:
            spans = [m.span() for m in re.finditer(p, r.t or "")]
            taken += [(a, b) for a, b in spans if all(b <= c or d <= a for c, d in taken)]
        assert r.noise == (round(100 * sum(b - a for a, b in taken) / len(r.t), 2) if r.t else 0.0), r.t
    pairs = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), ([], ["a"])], "a array<string>, b array<string>")
    assert [r.v for r in pairs.select(tx.similarity_of_sets(F.col("a"), F.col("b")).alias("v")).collect()] == [1 / 3, 0.0, 0.0]


def by_patterns(t):
    """The same values by the patterns alone."""
    numbers = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, tx.EMAIL, "[redacted_email]"), tx.PHONE, "[redacted_phone]"), tx.SSN, "[SSN]")
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"(\w)-\n(\w)", "$1$2"), r"[ \t]+", " ")
    lines = F.trim(F.regexp_replace(F.regexp_replace(lines, r"([^.!?:;\n])\n(?=[a-z])", "$1 "), r"\n{3,}", "\n\n"))
    parts = F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: F.trim(s, F.lit(" \n\t\r")) != ""))
    return [F.size(tx.word_list(t)), numbers(t), t.rlike(tx.SSN) | t.rlike(tx.PHONE) | t.rlike(tx.EMAIL), lines, F.regexp_replace(t, r"^\s+|\s+$", ""), F.when(parts > 0, F.size(tx.word_list(t)) / parts)]
