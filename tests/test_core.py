"""Operators of the core on small fixtures, with the edge cases that the supplied tables lack."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomwright.functions import scores as sc
from loomwright.functions import text as tx
from loomwright.operators import chunks as ch
from loomwright.operators import lineage as ln
from loomwright.operators import profile as pf
from loomwright.operators import quality_rules as qr
from loomwright.operators import retrieval as rt
from loomwright.operators import rules as rl


def value(spark, expression, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(expression).first()[0]


def test_profile_of_odd_values(spark):
    rows = [(1, 1.0, "a", datetime.date(2020, 1, 1)), (2, float("nan"), " N/A ", None), (-999, float("inf"), None, datetime.date(2021, 1, 1)), (None, 3.0, "a", None)]
    frame = spark.createDataFrame(rows, "i int, x double, s string, d date")
    found = {r.column_name: r for r in pf.column_profile(frame, F.lit("2021-01-11").cast("timestamp")).collect()}
    assert [found[c].null_count for c in "ixsd"] == [1, 1, 1, 2]
    assert found["i"].surrogate_null_count == 1 and found["s"].surrogate_null_count == 1
    assert found["x"].infinite_count == 1 and found["d"].days_since_latest == 10
    assert [found[c].dtype for c in "ixsd"] == ["int", "float", "string", "datetime"]
    empty = pf.column_profile(frame.where("false")).collect()
    assert len(empty) == 4 and all(r.row_count == 0 and r.null_pct == 0 for r in empty)


def test_sample_shape_equals_published_formulas(spark):
    frame = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double")
    row = pf.column_profile(frame).first()
    assert row.skew == pytest.approx(1.6970562748477143) and row.kurtosis == pytest.approx(3.152)


def test_person_names(spark):
    names = {"Mary Ann Smith": True, "Smith, John": True, "St. Mary Hospital": False, "A1 Bc": False, "one": False, "a@b Cd": False, "": False}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", pf.person_name(F.col("n")).alias("p")).collect()
    assert {r.n: bool(r.p) for r in rows} == names


def test_systematic_sample_counts_over_ranges(spark):
    frame = spark.range(0, 1003).repartition(7)
    got = [r.id for r in pf.systematic_sample(frame, ["id"], 100).collect()]
    assert got == list(range(0, 1003, 11))


def test_co_missing(spark):
    frame = spark.createDataFrame([(None, None, 1), (None, None, None), (1, 1, 1), (1, 1, None)], "a int, b int, c int")
    assert pf.co_missing_groups(frame) == [["a", "b"]]


def test_blocker_caps_the_score(spark):
    frame = spark.createDataFrame([(i, f"u{i}@x.org") for i in range(50)], "id int, email string")
    profile = pf.column_profile(frame).withColumn("table_name", F.lit("t"))
    found = rl.checks(rl.facts(profile))
    row = rl.table_scores(found).first()
    assert row.blockers == 1 and row.klass == "gated" and row.score <= 59
    assert found.where("dimension = 'labels'").count() == 0
    assert rl.simulate(found, "privacy_column_names").first().after >= row.score


def test_halves_round_to_even(spark):
    statuses = spark.createDataFrame([("t", "schema", "a", "info", s) for s in ("pass", "pass", "warn", "fail")], "table_name string, dimension string, rule_id string, severity string, status string")
    assert rl.dimension_scores(statuses).first().score == 62


def test_text_functions(spark):
    c = F.col("t")
    assert value(spark, tx.redact_pii(c), "a@b.org 555-123-4567 123-45-6789") == "[redacted_email] [redacted_phone] [SSN]"
    assert value(spark, tx.unwrapped(c), "exam-\nple line\ngoes on.\n\n\n\nNew") == "example line goes on.\n\nNew"
    assert value(spark, tx.char_chunks(c, 1, 0), "abcdefghij") == ["abcd", "efgh", "ij"]
    assert value(spark, tx.char_chunks(c, 1, 0), "") == []
    assert [p.page for p in value(spark, tx.pages(c), "=== PAGE 3 ===\nx\n=== PAGE 5 ===\ny")] == [3, 5]
    assert value(spark, tx.keywords(c, ["about"]), "Words about spreadsheets, planning and planning") == ["spreadsheets", "planning", "words"]
    assert value(spark, tx.low_quality(c), "") is True
    assert value(spark, sc.coherence(tx.sentences(c), c), "The cat sat on the mat today. The cat sat on the mat again. Entirely other words.") > 0
    assert value(spark, F.size(sc.hash_embedding(c, 40))) == 40
    assert value(spark, sc.fitted(F.array(F.lit(1.0)), 3)) == [1.0, 0.0, 0.0]


def test_sentence_chunks_keep_every_sentence():
    text = " ".join(f"Sentence number {i} is here." for i in range(30)) + " " + "word " * 200
    got = ch.packed_sentences(text, 20, 1)
    assert all(len(c) <= 80 for c in got) and all(any(f"number {i} " in c for c in got) for i in range(30))
    assert ch.packed_sentences("", 20, 1) == []


def test_acl(spark):
    chunks = spark.createDataFrame([(1, "p1", "d1", "Name"), (2, "p2", "d2", "address_line"), (3, "p3", "d3", "x")], "chunk_id long, product string, document string, field string")
    grants = lambda *rows: spark.createDataFrame(list(rows), "access string, value string")
    ids = lambda acl: {r.chunk_id for r in rt.allowed(chunks, acl).collect()}
    assert ids(grants(("index", "p1"), ("field", "ADDRESS"))) == {1, 2}
    assert ids(grants(("full", ""))) == {1, 2, 3}
    assert ids(grants(("document", "d3"), ("document", "d3"))) == {3}
    assert ids(grants(("index", "p9")).where("false")) == set()


def test_reach_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {(r.node, r.depth) for r in ln.reach(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_quality_rules(spark):
    frame = spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "s string, n int")
    found = qr.evaluate(frame, [qr.RowRule("r", "error", qr.required(["s"])), qr.RowRule("w", "warning", F.col("n") > 5)])
    assert {(r.rule, r.affected, r.violated) for r in found.collect()} == {("r", 2, True), ("w", 0, False)}
    assert qr.report_score(found).first().score == pytest.approx(1 / 3)
    shuffled = frame.repartition(3)
    assert qr.content_hash(frame, "n").first() == qr.content_hash(shuffled, "n").first()


def test_entry_lists_every_oracle():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
