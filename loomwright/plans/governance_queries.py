"""Quality rules, gates, versions and retention over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.operators import history as hs
from loomwright.operators import dispatch as di
from loomwright.operators import profile as pf
from loomwright.operators import version_store as vs
from loomwright.sources.folders import shared_folder
from loomwright.operators import quality_rules as qr
from loomwright.plans.registry import Registry, table

R = Registry()
#: Fixed value: the separators of Unicode's category Zs.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def rule(name: str, source: str, rules: list[tuple[str, str, object, str]]):
    """A query that evaluates rules; the oracle counts each condition."""
    sql = " UNION ALL ".join(f"SELECT '{n}' AS rule, '{s}' AS severity, count_if({c}) AS affected, count(*) AS items, count_if({c}) > 0 AS violated FROM {source}" for n, s, _, c in rules)
    R.add(name, sql)(lambda spark, sf_dir: qr.evaluate(table(spark, sf_dir, source), [qr.RowRule(n, s, f()) for n, s, f, _ in rules]))


rule("V01_required_fields", "documents", [("text", "error", lambda: qr.required(["text", "lang"]), "text IS NULL OR text = '' OR lang IS NULL OR lang = ''"), ("source", "warning", lambda: qr.required(["source"]), "source IS NULL OR source = ''")])
rule("V04_bad_extensions", "pages", [("html", "warning", lambda: F.lower("url").rlike(r"\.html?$"), r"regexp_matches(lower(url), '\.html?$')")])
rule("V05_freshness", "orders", [("stale", "warning", lambda: F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), "o_orderdate < TIMESTAMP '1996-01-01'")])
rule("V06_file_size", "documents", [("large", "warning", lambda: F.col("n_chars") > 5000, "n_chars > 5000"), ("small", "error", lambda: F.col("n_chars") < 100, "n_chars < 100")])
rule("V07_content_length", "documents", [("short", "error", lambda: F.length("text") < 50, "length(text) < 50"), ("long", "warning", lambda: F.length("text") > 20000, "length(text) > 20000")])


@R.add("V02_duplicate_rate", "SELECT round((count(*) - count(DISTINCT text)) / count(*), 6) AS duplicate_rate FROM documents")
def duplicate_rate(spark, sf_dir):
    return qr.duplicate_rate(table(spark, sf_dir, "documents"), ["text"]).select(F.round("duplicate_rate", 6).alias("duplicate_rate"))


@R.add("V03_chunk_coverage", "SELECT count_if(length(trim(text)) / n_chars < 0.99) AS low, count(*) AS items FROM documents")
def chunk_coverage(spark, sf_dir):
    """Blanks at the ends are those of any script, as SQL trims them; an item of no size covers nothing and is not low."""
    kept = F.length(F.trim("text", F.lit(BLANKS)))
    return table(spark, sf_dir, "documents").agg(F.count_if(F.try_divide(kept, F.col("n_chars")) < 0.99).alias("low"), F.count(F.lit(1)).alias("items"))


@R.add("G18_dq_report", "SELECT round(greatest(0.0, 1 - (2 * count_if(n_chars < 100) + count_if(n_chars > 5000)) / (2 * count(*))), 6) AS score FROM documents")
def dq_report(spark, sf_dir):
    rules = [qr.RowRule("small", "error", F.col("n_chars") < 100), qr.RowRule("large", "warning", F.col("n_chars") > 5000)]
    return qr.report_score(qr.evaluate(table(spark, sf_dir, "documents"), rules)).select(F.round("score", 6).alias("score"))


@R.add("V12_quality_gate", """WITH m AS (SELECT avg(n_chars) AS v FROM documents) SELECT 'avg_chars' AS metric, round(v, 4) AS value, v BETWEEN 100 AND 100000 AS passed FROM m UNION ALL SELECT 'missing', NULL, false""")
def quality_gate(spark, sf_dir):
    metrics = table(spark, sf_dir, "documents").agg(F.avg("n_chars").alias("value")).select(F.lit("avg_chars").alias("metric"), "value")
    limits = spark.createDataFrame([("avg_chars", 100.0, 100000.0), ("missing", 0.0, None)], "metric string, low double, high double")
    return qr.gate(metrics, limits).withColumn("value", F.round("value", 4))


@R.add("V13_alerts", "SELECT event_type, count(*) AS n FROM events WHERE value >= 90 AND ts >= (SELECT max(ts) - INTERVAL 30 DAY FROM events) GROUP BY event_type")
def alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    recent = e.where("value >= 90").join(F.broadcast(e.agg(F.max("ts").alias("last")))).where(F.col("ts") >= F.expr("last - INTERVAL 30 DAYS"))
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@R.add("V15_data_hash")
def data_hash(spark, sf_dir):
    return qr.content_hash(table(spark, sf_dir, "documents"), "doc_id")


#: Good rules, and three at fault: by their type, by a column that is not there, and by a value that is no number.
RULES = [
    di.Rule("has_type", "required_fields", "error", {"columns": ["event_type", "props"]}), di.Rule("fresh", "min_value", "warning", {"column": "value", "least": 5.0}, 0.2),
    di.Rule("props_length", "content_length", "info", {"column": "props", "least": 1, "most": 12}), di.Rule("odd", "of_no_type"), di.Rule("gone", "min_value", "warning", {"column": "no_such", "least": 1}),
    di.Rule("cast", "condition", "warning", {"broken": "CAST(event_type AS INT) > 1"}), di.Rule("blank", "bad_pattern", "warning", {"column": "event_type", "pattern": "^c"}, 0.9),
]


@R.add("V08_rule_dispatch", """WITH e AS (SELECT count(*) AS items, count_if(coalesce(event_type, '') = '' OR coalesce(props, '') = '') AS a, count_if(value < 5) AS b, count_if(length(props) NOT BETWEEN 1 AND 12) AS c, count_if(regexp_matches(event_type, '^c')) AS d FROM events)
SELECT 'has_type' AS rule, 'error' AS severity, a AS affected, items, a > 0 AS violated, NULL AS error FROM e UNION ALL SELECT 'fresh', 'warning', b, items, b > 0.2 * items, NULL FROM e UNION ALL SELECT 'props_length', 'info', c, items, c > 0, NULL FROM e
UNION ALL SELECT 'blank', 'warning', d, items, d > 0.9 * items, NULL FROM e UNION ALL SELECT 'odd', 'error', 1, items, true, 'unknown rule type of_no_type' FROM e UNION ALL SELECT 'gone', 'error', 1, items, true, 'UNRESOLVED_COLUMN.WITH_SUGGESTION' FROM e
UNION ALL SELECT 'cast', 'error', 1, items, true, 'CAST_INVALID_INPUT' FROM e""")  # fmt: skip
def rule_dispatch(spark, sf_dir):
    return di.validated(table(spark, sf_dir, "events"), RULES).drop("rule_type")


POLICIES = [
    di.Policy("no_debt", di.Rule("balance", "min_value", "error", {"column": "c_acctbal", "least": 0}), blocking=True), di.Policy("segment", di.Rule("segment", "bad_pattern", "warning", {"column": "c_mktsegment", "pattern": "^[A-F]"})),
    di.Policy("gone", di.Rule("gone", "required_fields", "error", {"columns": ["no_such"]}), blocking=True), di.Policy("off", di.Rule("all", "condition", "error", {"broken": "true"}), blocking=True, enabled=False),
]


@R.add("V11_policies", """SELECT c_custkey, CAST(3 AS BIGINT) AS policies, CAST((c_acctbal >= 0)::INTEGER + (NOT regexp_matches(c_mktsegment, '^[A-F]'))::INTEGER AS BIGINT) AS passed, CAST((c_acctbal < 0)::INTEGER + regexp_matches(c_mktsegment, '^[A-F]')::INTEGER AS BIGINT) AS failed,
CAST(1 AS BIGINT) AS errors, c_acctbal < 0 AS blocked FROM customer""")  # fmt: skip
def policies(spark, sf_dir):
    return di.summarised(di.evaluated(table(spark, sf_dir, "customer"), "c_custkey", POLICIES), "c_custkey")


@R.add("T09_profile_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, NULL AS error FROM {t}" for t in ("nation", "region", "supplier")) + " UNION ALL SELECT 'no_such_table', NULL, 'PATH_NOT_FOUND'")
def profile_tables(spark, sf_dir):
    """The profiles of the tables that can be read, and a row with the fault of the one that cannot."""
    found, faults = di.isolated({t: lambda t=t: table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "no_such_table")})
    rows = pf.table_profiles(found, only=set()).groupBy("table_name").agg(F.max("row_count").alias("row_count")).withColumn("error", F.lit(None).cast("string"))
    return rows.union(spark.createDataFrame([(t, None, fault) for t, fault in faults.items()], "table_name string, row_count long, error string"))


def run_history(spark, sf_dir):
    """Events stand for runs; every eleventh is deleted, and every thirteenth by a user whose it is not."""
    e = table(spark, sf_dir, "events")
    store = hs.HistoryStore(spark, shared_folder(spark) + "/runs")
    store.record(e.selectExpr("CAST(event_id AS STRING) AS run_id", "CAST(user_id AS STRING) AS user_id", "event_type AS source", "value AS score", "CASE WHEN value >= 80 THEN 'green' ELSE 'red' END AS tier", "props AS detail", "ts AS at"))
    store.delete(e.selectExpr("CAST(event_id AS STRING) AS run_id", "CAST(CASE WHEN event_id % 13 = 0 THEN user_id + 1 ELSE user_id END AS STRING) AS user_id").where("run_id % 11 = 0 OR run_id % 13 = 0"))
    return store


KEPT_RUNS = "SELECT * FROM events WHERE NOT (event_id % 11 = 0 AND event_id % 13 <> 0)"


@R.add("R24_user_runs", f"SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS runs, round(avg(value), 6) AS mean_score, max(ts) AS last_at FROM ({KEPT_RUNS}) GROUP BY user_id")
def user_runs(spark, sf_dir):
    return run_history(spark, sf_dir).users().withColumn("mean_score", F.round("mean_score", 6))


@R.add("R24_recent_runs", f"SELECT CAST(event_id AS VARCHAR) AS run_id, CAST(user_id AS VARCHAR) AS user_id, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS n FROM ({KEPT_RUNS})) WHERE n <= 3")
def recent_runs(spark, sf_dir):
    return run_history(spark, sf_dir).recent_of_all(3).select("run_id", "user_id", "place")


#: Three batches over the orders of a customer, numbered by date: all are created; those of status F are archived, the first
#: deprecated; every fifth customer goes back to the second, every seventh to one that is not there.
NUMBERED = "SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders"


def filled_store(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    numbered = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("entity_id"), "o_custkey", F.col("o_orderkey").alias("place"), "o_orderstatus", F.row_number().over(order).alias("version_number"))
    rows = lambda df, action: df.select("place", "entity_id", F.lit(action).alias("action"), F.col("version_number").cast("long").alias("version_number"), F.concat_ws("/", "place", "o_orderstatus").alias("data"))
    store = vs.VersionStore(spark, shared_folder(spark), buckets=8)
    # places of a batch are numbered as the versions are to be
    store.append(rows(numbered, "create").withColumn("place", F.col("version_number")))
    store.append(rows(numbered.where("o_orderstatus = 'F'"), "archive").union(rows(numbered.where("version_number = 1"), "deprecate").withColumn("place", -F.col("place"))))
    first = numbered.where("version_number = 1")
    back = rows(first.where("o_custkey % 5 = 0"), "rollback").withColumn("version_number", F.lit(2).cast("long"))
    return store, store.append(back.union(rows(first.where("o_custkey % 7 = 0"), "rollback").withColumns({"version_number": F.lit(999).cast("long"), "place": -F.col("place")})))


STATES = f"""WITH n AS ({NUMBERED}), c AS (SELECT o_custkey, max(n) AS newest FROM n GROUP BY o_custkey),
s AS (SELECT CAST(o_custkey AS VARCHAR) AS entity_id, n AS version_number, CASE WHEN o_custkey % 5 = 0 AND n = 2 THEN 'rolled_back' WHEN o_orderstatus = 'F' THEN 'archived' WHEN n = 1 THEN 'deprecated' ELSE 'active' END AS status, o_orderkey || '/' || o_orderstatus AS data, NULL::BIGINT AS rolled_back_from FROM n
UNION ALL SELECT CAST(n.o_custkey AS VARCHAR), newest + 1, 'active', o_orderkey || '/' || o_orderstatus, 2 FROM n JOIN c USING (o_custkey) WHERE n.n = 2 AND n.o_custkey % 5 = 0)"""


@R.add("V18_version_states", STATES + " SELECT entity_id, version_number, status, sha256(data) AS checksum, rolled_back_from FROM s")
def version_states(spark, sf_dir):
    return filled_store(spark, sf_dir)[0].snapshot().select("entity_id", "version_number", "status", "checksum", "rolled_back_from")


@R.add("V18_refused", f"WITH n AS ({NUMBERED}), c AS (SELECT o_custkey, max(n) AS newest FROM n GROUP BY o_custkey) SELECT CAST(o_custkey AS VARCHAR) AS entity_id, unnest(CASE WHEN o_custkey % 5 = 0 AND newest < 2 AND o_custkey % 7 = 0 THEN [2, 999] WHEN o_custkey % 5 = 0 AND newest < 2 THEN [2] ELSE [999] END)::BIGINT AS version_number, 'no such version' AS reason FROM c WHERE o_custkey % 5 = 0 AND newest < 2 OR o_custkey % 7 = 0")
def refused_transitions(spark, sf_dir):
    return filled_store(spark, sf_dir)[1].select("entity_id", "version_number", "reason")


@R.add("G25_version_counts", STATES + " SELECT entity_id, count(*) AS total, count_if(status = 'active') AS active, count_if(status = 'deprecated') AS deprecated, count_if(status = 'archived') AS archived, count_if(status = 'rolled_back') AS rolled_back, CAST(sum(strlen(data)) AS BIGINT) AS bytes, max(version_number) AS latest FROM s GROUP BY entity_id")
def versions_by_entity(spark, sf_dir):
    return vs.version_statistics(filled_store(spark, sf_dir)[0].states())


@R.add("V18_latest_versions", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    best = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("s"))
    return best.select("o_custkey", "s.o_orderkey", "s.o_orderstatus")


@R.add("V19_retention", "SELECT o_orderpriority, count(*) AS expired FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders) GROUP BY o_orderpriority")
def retention(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.join(F.broadcast(o.agg(F.max("o_orderdate").alias("last")))).where(F.col("o_orderdate") < F.expr("last - INTERVAL 365 DAYS"))
    return old.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("expired"))


@R.add("V20_keep_last_runs", "SELECT o_custkey, o_orderkey FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def keep_last_runs(spark, sf_dir):
    n = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").withColumn("n", n).where("n <= 3").select("o_custkey", "o_orderkey")


@R.add("V17_change_detection", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND upper(text) <> text")
def change_detection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.select("doc_id", F.xxhash64("text").alias("before"))
    new = d.select("doc_id", F.xxhash64(F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text"))).alias("after"))
    return old.join(new, "doc_id").where("before <> after").select("doc_id")


@R.add("V24_carry_forward", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'carried' ELSE 'kept' END AS origin FROM documents""")
def carry_forward(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    old, new = d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 <> 1").withColumnRenamed("checksum", "fresh")
    origin = F.when(F.col("fresh").isNull(), "carried").when(F.col("checksum").isNull() | (F.col("checksum") != F.col("fresh")), "new").otherwise("kept")
    return old.join(new, "doc_id", "full").select("doc_id", origin.alias("origin"))


QUERIES, ORACLE = R.queries, R.oracle
