"""Fallback scores against a plain version; JSON lines, metrics and archives on files of the test's own."""

import math
import re

import pytest
from pyspark.sql import functions as F

from loomwright.functions import scores as sc
from loomwright.operators import quality_rules as qr
from loomwright.operators import verdicts as vd
from loomwright.sources import files

TEXTS = [
    None, "", "  \n ", "One short line", "Dr. J. Smith came. He left! Was it 3 o'clock? 4 of them.", "=== PAGE 1 ===\n\n\n\nFirst sentence here. Second one\n=== PAGE 2 ===", "=== PAGE 3 ===", "mail me at a.b@c.org. Or 555-123-4567",
    "Grüße aus Köln. Überall. Ünder", "word " * 40 + ". Next", "a b c d e f g h i j k l. " * 300, "...", "Technik ist gut. Die TECHNIK",
]


def plain(text, section, field, doc, audience, tokens):
    text, section = (text or "").strip(), (section or "").strip().lower()
    fenced = re.sub(r"\n{3,}", "\n\n", re.sub(r"===\s*PAGE\s+\d+\s*===", " ", text))
    sizes = [len(s.split()) for s in re.split(r"(?<!\b[A-Z])[.!?]+(?=\s+[A-Z0-9\"'])", fenced) if s.strip()]
    n = sum(sizes) / len(sizes) if sizes else 0.0
    quality = n / 10 if n < 10 else max(0.0, 1 - (n - 30) / 30) if n > 30 else 1.0
    size = tokens or len(text) / 4
    words = re.findall(r"\w+", text.lower())
    context = 1.0 if section and section in text.lower() else 0.5
    meta = 1.0 if section and (field or "").strip() and (doc or "").strip() else 0.5
    got = {
        "Completeness": float(bool(text)), "Accuracy": sum(ord(c) < 128 for c in text[:1000]) / len(text[:1000]) if text else 1.0, "Secure": 0.75 if "@" in text or "555" in text else 1.0, "Quality": quality, "Timeliness": 0.5,
        "Token_Count": math.exp(-((size / 900 - 1) ** 2) / 0.5) if size > 0 else 0.0, "GPT_Confidence": 0.85, "Context_Quality": context, "Metadata_Presence": meta,
        "Audience_Intentionality": 0.25 if (audience or "").strip().lower() in ("", "unknown") else 1.0, "Diversity": len(set(words)) / len(words) if words else 0.0,
        "Audience_Accessibility": 1.0 if 10 <= n <= 25 else 1 - min(abs(n - 17.5) / 25, 1) if n > 0 else 0.0, "KnowledgeBase_Ready": 0.4 * meta + 0.4 * quality + 0.2 * context,
    }
    return {k: v * 100 for k, v in got.items()} | {"AI_Trust_Score": sum(got.get(k, 0) * w for k, w in sc.WEIGHTS.items()) * 100}


def test_fallback_scores(spark):
    rest = [("Technik", "title", "d1", "Dev", None), (None, "x", "d", " Unknown ", 900.0), ("first", " ", None, None, 0.0)]
    cases = [(i, t, *rest[i % 3]) for i, t in enumerate(TEXTS)] + [(100 + i, t, *rest[(i + 1) % 3]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(cases, "id int, text string, section string, field string, doc string, audience string, tokens double")
    got = {r.id: r.s.asDict() for r in df.select("id", sc.fallback_scores(*map(F.col, ("text", "section", "field", "doc", "audience", "tokens"))).alias("s")).collect()}
    for number, *case in cases:
        assert got[number] == pytest.approx(plain(*case), abs=0.0051), case


def test_escalations_fail_closed(spark):
    rows = [("t", "B13", "LOW", "present", None, 0), ("t", "B17", "LOW", "absent", None, 0), ("t", "O5", "LOW", "absent", None, 0), ("t", "O3", "LOW", "partial", None, 0), ("u", "B17", "LOW", "absent", None, 0)]
    got = {(r.table_name, r.field_id): (r.effective, r.escalation) for r in vd.escalated(spark.createDataFrame(rows, "table_name string, field_id string, severity string, status string, value string, covered int")).collect()}
    assert got["t", "B17"] == ("LOW", None) and got["u", "B17"] == ("HIGH", "ESC-1")
    assert got["t", "O5"] == ("HIGH", "ESC-2") and got["t", "O3"] == ("LOW", None)


def test_suggestions(spark):
    columns = ", ".join(f"{c} double" for c in [*qr.METRICS, *qr.THRESHOLDS]) + ", violations array<string>, passed boolean, playbook string"
    rows = [(*(None,) * 12, "TECH"), (90.0, 95.0, 90.0, 100.0, 95.0, 90.0, None, None, None, None, [], True, "TECH"), (40.0, 50.0, 60.0, 80.0, 70.0, 60.0, None, None, None, None, ["security_not_full"], False, None)]
    got = [r.asDict() for r in qr.suggestions(spark.createDataFrame(rows, columns)).coalesce(1).collect()]
    assert got[0]["topics"] == ["no_fingerprint"] and got[0]["actions"] == []
    assert got[1]["topics"] == ["monitor"] and got[1]["actions"] == [] and got[1]["next_playbook"] == "TECH"
    assert got[2]["topics"] == ["trust", "security", "metadata", "kb_ready", "completeness", "quality", "policy"] and got[2]["next_playbook"] == "SCANNED"
    assert got[2]["actions"] == ["quality_normalization", "chunk_overlap", "metadata_extraction", "playbook", "playbook", "chunk_overlap", "quality_normalization", "error_correction"]
    assert got[2]["tweaks"] == ["redaction_strict", "force_metadata_extraction", "increase_chunk_overlap"]


def test_json_and_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "2024-01-05"), (2, None, "2024-02-05"), (3, "x", None), (4, "y", "2024-01-31")], "id int, name string, day string").withColumn("day", F.col("day").cast("date"))
    files.write_json_lines(df.select("id", "name"), str(tmp_path / "lines"))
    assert sorted(files.json_lines(spark, str(tmp_path / "lines"), "id int, name string").collect())[0] == (1, "é")
    assert any('{"id":2,"name":null}' in p.read_text(encoding="utf-8") for p in (tmp_path / "lines").glob("part-*"))
    (tmp_path / "metrics.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    assert sorted(r.a for r in files.metrics(spark, str(tmp_path / "metrics.json"), "a int").collect()) == [1, 2]
    rest = files.archived(df, "day", "2024-02-01", str(tmp_path / "old"))
    assert sorted(r.id for r in rest.collect()) == [2, 3]
    old = spark.read.parquet(str(tmp_path / "old")).where("month = '2024-01'")
    assert sorted(r.id for r in old.collect()) == [1, 4]
