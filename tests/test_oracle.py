"""A sample of the registered queries against their DuckDB SQL at the smallest scale."""

from datetime import date, datetime, time

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["P06_nulls", "P17_correlated_pairs", "T05_systematic_sample", "R03_table_score", "rules_quality", "rules_features", "rules_metadata", "P20_type_mismatch", "P21_associated_pairs", "R04_reference_exclusion", "R08_evidence_basis", "R09_field_issues", "R12_dimension_detail", "R17_approvals", "R21_purpose_verdict", "R22_archetype_floors", "R25_annotation", "R26_criticality", "T06_block_sample", "T08_order_columns", "X02_redact_pii", "C10_diversity", "G10_monthly_stats", "J08_acl_filter", "K02_knn", "K08_context_assembly", "X04_pages", "X06_slug", "L01_dangling_edges", "L03_lineage_reach", "L05_artifact_lineage", "V12_quality_gate", "R13c_escalations", "R14_metadata_retune", "V10_suggestions"]


def plain(v):
    """A date and its midnight are one value: DuckDB hands dates to pandas as timestamps."""
    if isinstance(v, float):
        return str(round(v, 5))
    return str(datetime.combine(v, time()) if isinstance(v, date) and not isinstance(v, datetime) else v)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = connection.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    number = lambda t: [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in t]
    assert number(rows(got)) == number(rows(want))
