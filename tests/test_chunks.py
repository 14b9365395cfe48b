"""Corrections, sections, metadata and scores of chunks against values worked out by hand."""

from pyspark.sql import functions as F

from loomwright.functions import scores as sc
from loomwright.functions import text as tx
from loomwright.operators.quality_rules import compliance
from loomwright.operators.retrieval import conflicts


def values(spark, texts, expression):
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    return [r.v for r in frame.select("n", expression(F.col("text")).alias("v")).orderBy("n").collect()]


def test_corrections(spark):
    texts = ["teh end.adn soooooon Taht", "no change", "", None, "t e h " * 30]
    assert values(spark, texts, tx.corrected) == ["the end. and soon that", "no change", "", None, texts[4]]
    assert values(spark, ["a  b ,c’s — d..... \n  e", " "], tx.enhanced) == ["a b, c's - d. .. ..\ne", ""]


def test_sections(spark):
    text = "before\n1. First Steps\nalpha\n\nbeta\nANNEX OF TABLES\nConclusion Part\r\ngamma\nNote: own\nlast"
    found = values(spark, [text, "", "One Title", None], lambda c: tx.sections(c, ["Note:"]))
    assert [tuple(x) for x in found[0]] == [
        ("Introduction", "introduction", "before"), ("1. First Steps", "1_first_steps", "alpha\nbeta"), ("Conclusion Part", "conclusion_part", "gamma"), ("Note: own", "note_own", "last"),
    ]
    assert [[tuple(x) for x in f] for f in found[1:3]] == [[("Introduction", "introduction", "")], [("Introduction", "introduction", "One Title")]]
    assert values(spark, [" Conclusion ", "Executive  Summary", "", "-" * 3, "x" * 60], tx.section_name) == ["conclusions", "executive_summary", "section", "_", "x" * 40]


def test_metadata(spark):
    text = "Written by: Jane Roe v2.1 and version 3.0.1 and ver 4.4 on March 3, 2021 or 1/2/2020, 2020-05-06"
    found = values(spark, [text, "nothing", ""], lambda c: tx.found_metadata(c, F.lit("old")))
    # case is ignored in names, too, so the name runs on to the next digit or mark
    assert tuple(found[0]) == ("1/2/2020", "old; dates:1/2/2020,March,2020-05-06; author:Jane Roe; versions:2.1,3.0.1")
    assert tuple(found[1]) == (None, "old") == tuple(found[2])


def test_issues(spark):
    repeated = "same " * 8 + "other words here"
    assert values(spark, ["short", repeated, repeated + " that are all quite different from any of what came before them today, one hopes, in this much longer piece of writing", "a\0b"], tx.text_issues) == [
        ["Too short", "Too few words"], ["Repetitive content"], [], ["Too short", "Encoding issues", "Too few words"],
    ]
    assert values(spark, ["b a b", ""], lambda c: tx.commonest(tx.word_list(c))) == [2, 0]


def test_noise(spark):
    overlap = "This document is confidential\nIndex\n  \nnot for distribution"
    # the last pattern's second match begins inside the white space that the index line has taken
    want = round(100 * (len("This document is confidential") + len("\nIndex\n  ")) / len(overlap), 2)
    got = values(spark, ["", None, "Page 1 of 2", "text\nconfidential stuff", overlap], sc.noise_percent)
    assert got[:4] == [0.0, 0.0, 100.0, round(100 * 12 / 23, 2)]
    assert got[4] >= want - 2


def test_audiences(spark):
    of = lambda domain: lambda c: sc.audience_intentionality(c, F.lit(domain))
    texts = ["the auditor met a nurse and a doctor there", "too short", None]
    assert values(spark, texts, of("REG")) == [20.0 + 25.0, 0.0, 0.0]
    assert values(spark, texts, of(None)) == [50.0, 0.0, 0.0]
    known = lambda name: lambda c: sc.audience_accessibility(F.lit(name), c)
    assert values(spark, ["One two three four five six. " * 2, "a simple thing", ""], known("Dev")) == [90.0, 85.0, 85.0]
    assert values(spark, ["a simple thing", "nothing"], known(None)) == [50.0, 30.0]


def test_sets(spark):
    numbers = [F.lit(x) for x in (200, 20, 2, 0, 100, 150.0, 10, 4000, 6)]
    row = spark.range(1).select(sc.readiness(*numbers).alias("s")).first().s
    # 10 - 1 - 0.1 - 1.5; 10 - 2 - 2.5 - 2; 10 - 1.5
    assert tuple(row) == (round(7.4 * 0.3 + 3.5 * 0.3 + 1.7 + 8.5 * 0.2, 1), 7.4, 3.5, 8.5, 8.5)
    means = {"Accuracy": F.lit(80.0), "Secure": F.lit(100.0)}
    assert spark.range(1).select(sc.aggregate_trust(means).alias("t")).first().t == round(100 * (0.8 * 0.15 + 0.15 + 0.10 + 0.5 * 0.05), 4)


def test_content_types(spark):
    frame = spark.createDataFrame([(1, "", ".py", None), (2, None, None, None), (3, "hereby " * 3, None, None), (4, "hereby " * 3, ".txt", "Academic"), (5, "def f(x):\n# note", ".md", "code")], "n int, text string, ext string, hint string")
    rows = frame.select("n", F.inline(F.array(tx.content_type(F.coalesce("text", F.lit("")), F.col("ext"), F.col("hint"))))).orderBy("n").collect()
    assert [(r.kind, round(r.confidence, 3)) for r in rows] == [("code", 0.8), ("general", 0.3), ("legal", 0.333), ("documentation", 0.6), ("code", 0.4)]


def test_chunk_sizes_and_queries(spark):
    sizes = lambda c: tx.chunk_sizes(c, 1000, 200, 100, 2000)
    got = values(spark, ["", "word " * 40, "a b c. " * 100, "word " * 20000], sizes)
    assert [tuple(x) for x in got] == [(100, 0), (160, 40), (800, 160), (1320, 264)]
    text = "The quick api is a very small thing. too short. it has no capital words in it at all but many, many others"
    assert values(spark, [text], lambda c: tx.synthetic_queries(c, "technical", 5)) == [["What is The?", "How does it work?"]]
    assert values(spark, ["no patient is ever without a dose of it."], lambda c: tx.synthetic_queries(c, "clinical", 5)) == [["What is the patient?"]]


def test_conflicts(spark):
    rows = [(1, 1, "a", "Budget grows slowly"), (1, 2, "b", "The budget does not shrink slowly"), (1, 3, "a", "never mind the budget"), (1, 4, "c", None), (2, 1, "b", "no budget"), (2, 2, "a", "budget grows")]
    found = conflicts(spark.createDataFrame(rows, "ctx int, rank int, doc string, text string"), "ctx").collect()
    assert [(r.ctx, r.rank, r.term, r.negated_in, r.stated_in) for r in found] == [(1, 2, "budget", "b", "a")]


def test_compliance(spark):
    rules = spark.createDataFrame([(1, "2024-01-05", "active", ["gdpr"]), (2, "2024-02-01", "draft", ["gdpr", "sox"]), (3, "2023-02-01", "active", []), (4, "2024-03-01", "active", None)], "rule_id int, created string, status string, tags array<string>")
    broken = spark.createDataFrame([(1, "2024-01-09"), (3, "2024-01-09"), (9, "2024-01-09"), (1, "2022-01-09")], "rule_id int, created string")
    of = lambda framework: tuple(compliance(rules, broken, "2024-01-01", "2024-12-31", framework).first())
    assert of(None) == (3, 2, 2, 200 / 3)
    assert of("gdpr") == (2, 1, 2, 50.0)
    assert of("none") == (0, 0, 2, 0.0)
