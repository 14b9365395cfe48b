"""The register of metadata fields, reconciliation and capability levels against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loomwright.operators import capabilities as cp
from loomwright.operators import reconcile as rc
from loomwright.operators import register as rg

NAMES = sorted({*rg.ATTRIBUTES, "field_role"})


def entries(spark, rows):
    """rows: (table_name, position, column_name, attributes)."""
    kinds = ", ".join(["table_name string", "position int", "column_name string", *(f"{n} string" for n in NAMES)])
    return spark.createDataFrame([(t, p, c, *(a.get(n) for n in NAMES)) for t, p, c, a in rows], kinds)


@pytest.fixture(scope="module")
def fields(spark):
    tables = spark.createDataFrame([("bare", 10, 4), ("told", 0, 4), ("none", 5, 0)], "table_name string, row_count long, column_count long")
    rows = [
        ("told", 0, "a", {"definition": "  ", "description": "never read", "business_owner": " \t", "pii_flag": "Y", "primary_foreign_key": "PK", "nullable_declared": "N", "data_steward": "TBD"}),
        ("told", 1, "b", {"definition": "", "description": "d" * 120, "business_owner": " Ann ", "pii_flag": "N", "primary_foreign_key": "fk to x", "data_type_declared": "int", "consent_basis": "contract"}),
        ("told", 2, "c", {"definition": "short", "pii_flag": " ", "valid_values_range": "0-9", "data_type_declared": " "}),
    ]
    return rg.field_quality(tables, entries(spark, rows)).cache()


def test_register_has_44_fields(fields):
    assert len(rg.REGISTER) == 44 and [len([f for f in rg.REGISTER if f[2] == c]) for c in rg.CATEGORIES] == [21, 9, 9, 5]
    assert {r.table_name: r["count"] for r in fields.groupBy("table_name").count().collect()} == {"bare": 44, "told": 44, "none": 44}


def test_extraction_and_validation(fields):
    got = {r.field_id: r for r in fields.where("table_name = 'told'").collect()}
    assert got["B2"].value == "d" * 120 and got["B2"].state == "present"
    assert got["B5"].value == "Ann" and got["T3"].value == "PK" and got["T4"].value == "fk to x"
    assert got["B6"].state == "invalid" and got["B1"].state == "absent"
    assert (got["B3"].covered, got["B3"].total, got["B3"].state) == (1, 4, "invalid")  # a quarter of the columns
    assert (got["T2"].covered, got["T2"].state, got["T2"].earned) == (2, "present", 1.5)
    assert (got["B13"].covered, got["B13"].earned) == (2, 1.5) and got["T7"].state == "invalid"
    assert got["O6"].value == "0" and got["O6"].valid and got["T1"].value == "told"
    # fail closed: what is absent raises others, and flags on columns do so, too
    assert [(got[f].effective, got[f].escalation) for f in ("B17", "B21", "O5", "O3", "B20", "B7")] == [("HIGH", "ESC-1"), ("HIGH", "ESC-1"), ("HIGH", "ESC-2"), ("MEDIUM", "ESC-3"), ("HIGH", "ESC-4"), ("MEDIUM", None)]
    bare = {r.field_id: r for r in fields.where("table_name = 'bare'").collect()}
    assert {f for f, r in bare.items() if r.valid} == {"T1", "O6"} and bare["B13"].state == "absent" and bare["B13"].covered == 0


def test_scores_and_remediation(fields):
    got = {r.table_name: r for r in rg.metadata_quality(fields).collect()}
    technical = sum(rg.POINTS[f[3]] for f in rg.REGISTER if f[2] == "technical")
    assert got["bare"].verdict == "RED" and got["bare"].technical == round(3 / technical, 4) and got["bare"].business == 0
    assert got["told"].technical == round((3 + 1.5 + 3 + 2) / technical, 4)
    assert got["told"].quality == round(100 * sum(got["told"][c] for c in rg.CATEGORIES) / 4)
    steps = rg.remediation(fields.where("table_name = 'bare'")).orderBy("priority").collect()
    ranks = ["HIGH", "MEDIUM", "LOW"]
    assert len(steps) == 42 and [ranks.index(r.effective) for r in steps] == sorted(ranks.index(r.effective) for r in steps)
    assert steps[0].field_id == "B1" and {r.owner for r in steps if r.field_id.startswith("B")} == {"business"}


def test_reconciliation(spark):
    profile = spark.createDataFrame(
        [("t", "Key", "int", 100, 0, 0.0, 100), ("t", "part", "string", 100, 20, 20.0, 50), ("t", "gone_null", "float", 100, 100, 100.0, 0), ("t", "email", "string", 100, 0, 0.0, 90), ("u", "x", "int", 5, 0, 0.0, 5)],
        "table_name string, column_name string, dtype string, row_count long, null_count long, null_pct double, unique_count long",
    )
    rows = [
        ("t", 0, "KEY", {"data_type_declared": " BigInt", "primary_foreign_key": "pk", "cardinality_declared": "95", "valid_values_range": "10-2", "last_synced_at": "2024-01-01T00:00:00Z"}),
        ("t", 1, "part", {"data_type_declared": "text"}),  # the later entry of a name counts
        ("t", 2, "PART", {"data_type_declared": "int", "nullable_declared": "not null", "primary_foreign_key": "Primary Key", "cardinality_declared": " 40 ", "pii_flag": "no"}),
        ("t", 3, "gone_null", {"field_role": "feature", "cardinality_declared": "7", "data_type_declared": "unheard of"}),
        ("t", 4, "email", {"pii_flag": "N", "valid_values_range": "low..high", "last_synced_at": "2020-01-01T00:00:00"}),
        ("t", 5, "not_there", {"valid_values_range": "3..1", "last_synced_at": "2024-03-30T00:00:00+02:00"}),
    ]
    got = rc.reconciled(profile, entries(spark, rows), F.lit("2024-04-10 00:00:00").cast("timestamp")).collect()
    assert sorted((r.table_name, r.column_name, r.field, r.observed, r.severity, r.status) for r in got) == sorted([
        ("t", "KEY", "valid_values_range", "(internal check)", "warning", "confirmed"), ("t", "KEY", "last_synced_at", "100 days old", "warning", "confirmed"),
        ("t", "part", "data_type", "string", "warning", "confirmed"), ("t", "part", "nullable", "20 nulls (20.0%)", "warning", "confirmed"), ("t", "part", "primary_key", "50/100 unique", "warning", "confirmed"),
        ("t", "part", "cardinality", "50", "warning", "confirmed"), ("t", "part", "pii_flag_values", "values not checked", "info", "could_not_verify"), ("t", "gone_null", "field_role", "100% null", "warning", "confirmed"),
        ("t", "email", "pii_flag", "name suggests personal data", "warning", "confirmed"), ("t", "not_there", "valid_values_range", "(internal check)", "warning", "confirmed"), ("u", "*", "reconciliation", "(profile only)", "info", "could_not_verify"),
    ])


def level(spark, statuses, facts=None, told=()):
    rows = [("t", r, s) for r, s in statuses.items()] or [("t", "other", "pass")]
    found = spark.createDataFrame(rows, "table_name string, rule_id string, status string")
    values = {"n": 2000, "coverage": 0.0, "pearson_pairs": 0, "texts": 0} | (facts or {})
    table = spark.createDataFrame([("t", *values.values())], "table_name string, n long, coverage double, pearson_pairs long, texts long")
    return {r.capability: r.level for r in cp.capability_levels(found, table, entries(spark, [("t", 0, "a", dict(told))] if told else [])).collect()}


def test_capability_levels(spark):
    bare = level(spark, {})
    assert bare == {"SEM": 0, "JOIN": 0, "GOV": 2, "AGG": 2, "ACC": 0, "FRS": 2, "LBL": 0, "LKG": 3, "SIG": 3, "STA": 3, "TMP": 3, "VOL": 2, "LIN": 0, "TXT": 3}
    every = level(spark, {r: "pass" for r in cp.READ}, {"n": 10_000, "coverage": 90.0, "pearson_pairs": 1, "texts": 1}, {"lineage": "x", "data_steward": "y", "ai_ml_usage_approval": "yes"})
    assert every == {"SEM": 4, "JOIN": 3, "GOV": 4, "AGG": 3, "ACC": 4, "FRS": 4, "LBL": 4, "LKG": 4, "SIG": 4, "STA": 4, "TMP": 4, "VOL": 4, "LIN": 4, "TXT": 2}
    worst = level(spark, {r: "fail" for r in cp.READ}, {"coverage": 39.0, "texts": 1}, {"source_system": "x"})
    assert worst == {"SEM": 1, "JOIN": 0, "GOV": 0, "AGG": 0, "ACC": 0, "FRS": 0, "LBL": 0, "LKG": 0, "SIG": 0, "STA": 1, "TMP": 0, "VOL": 0, "LIN": 2, "TXT": 2}
    mixed = level(spark, {"privacy_column_names": "pass", "privacy_values": "deferred", "labels_target": "pass", "labels_timestamps": "pass", "labels_leakage": "deferred", "features_numeric": "warn", "temporal_freshness": "pass", "quality_rowcount": "pass", "ops_cadence": "pass"}, {"n": 5000, "coverage": 70.0}, {"business_owner": "x"})
    assert {k: mixed[k] for k in ("GOV", "LBL", "LKG", "SIG", "FRS", "VOL", "ACC", "SEM", "LIN")} == {"GOV": 1, "LBL": 3, "LKG": 1, "SIG": 2, "FRS": 3, "VOL": 3, "ACC": 1, "SEM": 3, "LIN": 2}
