"""Measured facts, rules and verdicts against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loomwright.operators import measures as ms
from loomwright.operators import profile as pf
from loomwright.operators import rules as rl
from loomwright.operators import verdicts as vd


@pytest.fixture(scope="module")
def patients(spark):
    """60 rows: a key, a constant, two columns null together, a doubled column, numbers as text, persons, one repeated row."""
    rows = [(i, "same" if i else "other", None if i % 3 else i, None if i % 3 else "x", float(i), 2.0 * i, str(i), "Mary Smith" if i == 7 else "n/a") for i in range(59)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "visit int, site string, a int, b string, weight double, doubled double, code string, notes string")


def test_measured_facts(spark, patients):
    words = [("VISIT", "number of the visit", "int", "approved", "nightly"), ("site", " ", "float", None, None), ("gone", "x", "int", "denied", None)]
    dictionary = spark.createDataFrame([("patients", *w) for w in words], "table_name string, column_name string, definition string, data_type string, consent string, refresh string")
    kinds = {"patients": {f.name: pf.dtype_of(f.dataType) for f in patients.schema}}
    rows = ms.measured({"patients": patients}, {"patients": ["visit"]}).union(ms.dictionary_facts(dictionary, kinds))
    got = {r.fact: r.value for r in rows.collect()}
    assert got["dup_rows"] == 1 and got["co_missing"] == 1 and got["pii_values"] == 1
    assert got["near_constant"] == 3  # site, b and notes
    assert got["mismatched"] == 1  # code holds numbers
    assert got["pearson_pairs"] == 6  # visit, a, weight and doubled rise together
    assert (got["entries"], got["matched"], got["documented"], got["dictionary_mismatches"], got["approved"], got["denied"], got["cadence_known"]) == (3, 2, 1, 1, 1, 1, 1)
    assert got["coverage"] == 25.0
    facts = rl.facts(pf.column_profile(patients).withColumn("table_name", F.lit("patients")), rows)
    status = {r.rule_id: r.status for r in rl.checks(facts).collect()}
    expected = {
        "quality_duplicates": "fail", "quality_type_consistency": "warn", "features_near_constant": "warn", "features_type_mismatch": "warn", "features_missingness_pattern": "warn", "features_mixed_correlation": "warn",
        "stats_multicollinearity": "warn", "privacy_values": "deferred", "metadata_dictionary": "fail", "metadata_recon_rate": "fail", "metadata_consent_approval": "pass", "metadata_doc_coverage": "fail", "ops_cadence": "pass",
        "schema_pk": "warn", "quality_rowcount": "fail", "temporal_present": "fail",
    }
    assert {r: status[r] for r in expected} == expected | {"schema_pk": "fail"}


def test_clean_table_passes_what_it_should(spark):
    frame = spark.createDataFrame([(i, "abcdefgh"[i % 8], (i * 37) % 101 / 7.0) for i in range(1200)], "row_key int, kind string, amount double")
    rows = ms.measured({"t": frame}, {"t": ["row_key"]})
    assert [r for r in rows.collect() if r.value] == []
    facts = rl.facts(pf.column_profile(frame).withColumn("table_name", F.lit("t")), rows)
    status = {r.rule_id: r.status for r in rl.checks(facts).collect()}
    for rule in ("quality_duplicates", "features_near_constant", "features_type_mismatch", "features_missingness_pattern", "features_mixed_correlation", "stats_multicollinearity", "privacy_values", "schema_pk", "quality_rowcount"):
        assert status[rule] == "pass", rule
    assert status["metadata_dictionary"] == "warn" and status["ops_cadence"] == "warn"


def test_detected_types(spark):
    frame = spark.createDataFrame([("1", "2020-01-01", 1, True, None), ("2.5", "2020-02-01", 2, False, None)], "n string, d string, few int, flag boolean, none string")
    got = {r.column_name: r.detected_as for r in ms.detected_types(frame).collect()}
    assert got == {"n": "Numeric", "d": "DateTime", "few": "Categorical", "flag": "Boolean", "none": "Unsupported"}
    assert ms.type_mismatches(frame.where("false")).count() == 5


def test_approvals_and_acknowledged_blockers(spark):
    rows = [("t", "privacy", "privacy_column_names", "blocker", "fail"), ("t", "labels", "labels_leakage", "blocker", "deferred"), ("t", "schema", "schema_pk", "warning", "pass"), ("t", "features", "features_cardinality", "warning", "fail")]
    found = spark.createDataFrame(rows, "table_name string, dimension string, rule_id string, severity string, status string")
    score = lambda *a: vd.rescore(found, *a).first()
    assert (score([]).score, score([]).klass) == (22.0, "gated")
    assert score(["labels_leakage"]).score == 56.0  # (10 + 15) of 45
    assert score(["labels_leakage"], ["privacy_column_names"]).klass == "conditional"
    assert score(["labels_leakage"], [], ["features_cardinality", "schema_pk"]).score == 59.0  # 78, capped


def test_verdicts(spark):
    levels = spark.createDataFrame([("t", c, n) for c, n in (("SEM", 4), ("GOV", 3), ("FRS", 2), ("TXT", 3))] + [("u", c, 0) for c in ("SEM", "GOV", "TXT")], "table_name string, capability string, level int")
    gated = spark.createDataFrame([], "table_name string, rule_id string")
    got = {(r.table_name, r.archetype): r.verdict for r in vd.verdicts(levels, gated).collect()}
    assert got["t", "agent_rag"] == "Ready" and got["u", "agent_rag"] == "Purpose Mismatch" and got["t", "mcp_write"] == "Conditional"
    gated = spark.createDataFrame([("t", "privacy_column_names")], "table_name string, rule_id string")
    got = {r.archetype: r.verdict for r in vd.verdicts(levels, gated).where("table_name = 't'").collect()}
    assert got["agent_rag"] == "At Risk" and got["conformed_reference"] == "Ready"


def test_samples_and_counts(spark):
    assert vd.sample_percent(0, 10) == 100 and vd.sample_percent(30, 10) == 50 and vd.sample_percent(10**9, 10) == 0.01
    frame = spark.range(1000)
    assert 0 < vd.block_sample(frame, 100).count() <= 100 and vd.block_sample(frame.where("false"), 10).count() == 0
    assert vd.order_columns(spark.createDataFrame([(1, [1.0], "x")], "id int, v array<double>, s string")) == ["id", "s"]
    assert vd.catalogued_count(frame) == 1000 and vd.catalogued_count(frame, "no_such_table") == 1000


def test_exclusions(spark):
    facts = spark.createDataFrame([("a", 5000), ("b", 5000), ("c", 10)], "table_name string, n long")
    kinds = spark.createDataFrame([("a", " Staging "), ("b", "fact")], "table_name string, classification string")
    got = {r.table_name: (r.klass, r.reason) for r in vd.exclusions(facts, kinds).collect()}
    assert got == {"a": ("reference", "declared staging"), "b": ("assessed", None), "c": ("reference", "10 rows, below 1000")}
