"""What follows from the statuses of rules: exclusions, evidence, issues, approvals, verdicts, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.operators import rules as rl

# Fixed values.
EXCLUDED = ["reference", "staging", "lookup", "enum"]
DISMISSIBLE = ["temporal_ordering", "temporal_granularity", "stats_no_constants", "labels_balance", "features_cardinality"]
ASSOCIATION_RULES = ["labels_leakage", "privacy_values", "ops_partition"]
DICTIONARY_RULES = ["metadata_dictionary", "ops_cadence"]
FLOORS = {
    "agent_rag": ({"SEM": 3, "GOV": 3, "FRS": 2, "TXT": 2}, ["privacy_column_names"]),
    "batch_scoring": ({"ACC": 4, "FRS": 4, "SIG": 3, "JOIN": 3, "GOV": 3, "LIN": 3}, ["privacy_column_names"]),
    "conformed_reference": ({"JOIN": 4, "SEM": 4, "GOV": 2, "ACC": 2}, []),
    "feature_store": ({"JOIN": 3, "FRS": 3, "SIG": 3, "ACC": 3, "TMP": 2, "LIN": 3}, ["privacy_column_names"]),
    "mcp_read": ({"SEM": 3, "GOV": 3, "ACC": 2, "AGG": 2}, ["privacy_column_names"]),
    "mcp_write": ({"SEM": 3, "GOV": 4, "ACC": 3, "AGG": 3, "JOIN": 2}, ["privacy_column_names"]),
    "nl_query": ({"SEM": 4, "GOV": 2, "AGG": 3, "TMP": 2}, ["privacy_column_names"]),
    "reporting_analytics": ({"AGG": 3, "SEM": 3, "JOIN": 3, "TMP": 2, "GOV": 2}, ["privacy_column_names"]),
    "semantic_search": ({"SEM": 3, "TXT": 3, "GOV": 2, "FRS": 2}, ["privacy_column_names"]),
    "supervised_classification": ({"LBL": 3, "LKG": 3, "SIG": 3, "VOL": 3, "TMP": 2, "GOV": 2}, ["privacy_column_names", "labels_leakage"]),
    "supervised_regression": ({"LBL": 2, "LKG": 3, "SIG": 3, "VOL": 3, "STA": 2, "GOV": 2}, ["privacy_column_names", "labels_leakage"]),
    "time_series_forecast": ({"TMP": 4, "FRS": 3, "VOL": 3, "SIG": 2, "STA": 2, "LBL": 3}, ["privacy_column_names"]),
}
#: A rule's trigger, the fields that it raises, and to what.
ESCALATIONS = {"ESC-1": ("B13", ["B17", "B21"], "HIGH"), "ESC-2": ("B7", ["O5"], "HIGH"), "ESC-3": ("O3", ["O3"], "MEDIUM"), "ESC-4": ("B14", ["B20"], "HIGH")}
# What columns are named like.
ANNOTATIONS = {
    "direct": r"(?i)(^|_)(ssn|social_security|passport|national_id|mrn|patient_id|patientid|member_id|email|e_mail|phone|mobile|telephone|first_name|firstname|last_name|lastname|full_name|fullname|dob|date_of_birth|street|address_line)($|_)",
    "quasi": r"(?i)(^|_)(age|sex|gender|zip|zip3|postal|postcode|region|county|city|state|province|ethnicity|race|marital|birth_year|nationality)($|_)",
    "target": r"(?i)(^|_)(target|label|outcome|class|condition|diagnosis|response|churn|y)($|_)",
    "event": r"(?i)(^|_)(admit|discharge|order|visit|event|txn|transaction|purchase|claim|encounter|service|start|end|date|time|_ts|timestamp|dt)($|_)",
    "load": r"(?i)(^|_)(created|create_ts|inserted|ingest|load|etl|_loaded|updated_at|last_updated|sync)($|_)",
    "leakage": r"(?i)(_outcome|_resolved|_followup|resolution|outcome_flag|_final|after_|post_)",
}
UNORDERED = ["array", "binary", "map", "struct", "variant", "null"]


def exclusions(table_facts: DataFrame, dictionary: DataFrame | None = None, least_rows: int = 1000) -> DataFrame:
    """(table_name, klass, reason): tables that a dictionary (table_name, classification) names, or that are short, are references."""
    found = table_facts.select("table_name", "n")
    if dictionary is None:
        named = found.withColumn("declared", F.lit(None).cast("string"))
    else:
        kind = F.lower(F.trim("classification"))
        named = found.join(dictionary.where(kind.isin(EXCLUDED)).groupBy("table_name").agg(F.min(kind).alias("declared")), "table_name", "left")
    reason = F.when(F.col("declared").isNotNull(), F.concat(F.lit("declared "), "declared")).when(F.col("n") < least_rows, F.concat(F.col("n").cast("string"), F.lit(f" rows, below {least_rows}")))
    return named.select("table_name", F.when(reason.isNotNull(), "reference").otherwise("assessed").alias("klass"), reason.alias("reason"))


def evidence_basis(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """found with basis: association, dictionary, or exact, which is sample where sizes (table_name, row_count, profiled) says so."""
    plain = F.when(F.col("rule_id").isin(ASSOCIATION_RULES), "association").when(F.col("rule_id").isin(DICTIONARY_RULES), "dictionary").otherwise("exact")
    capped = (F.col("profiled") > 0) & (F.col("profiled") < F.col("row_count"))
    return found.join(sizes, "table_name", "left").withColumn("basis", F.when((plain == "exact") & capped, "sample").otherwise(plain)).drop("row_count", "profiled")


def candidates(profile: DataFrame) -> DataFrame:
    """(table_name, rule_id, field): the columns that a rule's evidence names."""
    name = lambda pattern: F.col("column_name").rlike(rl.PATTERNS[pattern])
    tests = {
        "privacy_column_names": name("pii"), "labels_leakage": name("post_event") & ~name("target"), "quality_col_nulls": F.col("null_pct") > 50, "features_infinites": F.col("infinite_count") > 0,
        "features_cardinality": F.col("dtype").isin("string", "object", "bool") & (F.col("unique_count") > 50) & (F.col("unique_count") > 0.5 * F.col("row_count")),
    }
    rules = F.array(*[F.when(test, F.lit(rule)) for rule, test in tests.items()])
    return profile.select("table_name", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule_id"), F.col("column_name").alias("field"))


def field_issues(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each column that a failing blocker or warning names."""
    weighty = found.where(~F.col("status").isin("pass", "deferred") & F.col("severity").isin("blocker", "warning"))
    return weighty.join(evidence, ["table_name", "rule_id"]).select("table_name", "field", "dimension", "severity", "rule_id")


def dimension_detail(found: DataFrame, scores: DataFrame, green: float = 80) -> DataFrame:
    """(dimension, weak_tables, issues): tables whose score is below green, and rules that warn or fail, both sorted."""
    weak = scores.groupBy("dimension").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("score") < green, F.col("table_name")))), ",").alias("weak_tables"))
    issues = found.groupBy("dimension").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("status").isin("fail", "warn"), F.col("rule_id")))), ",").alias("issues"))
    return weak.join(issues, "dimension")


def with_approvals(found: DataFrame, approved: list[str], dismissed: list[str] = ()) -> DataFrame:
    """found with approved deferred rules, and dismissed ones that may be dismissed, as passes."""
    dismissed = [r for r in dismissed if r in DISMISSIBLE]
    resolved = (F.col("rule_id").isin(list(approved)) & (F.col("status") == "deferred")) | (F.col("rule_id").isin(dismissed) & F.col("status").isin("warn", "fail"))
    return found.withColumn("status", F.when(resolved, "pass").otherwise(F.col("status")))


def rescore(found: DataFrame, approved: list[str], acknowledged: list[str] = (), dismissed: list[str] = ()) -> DataFrame:
    """(table_name, score, tier, klass, blockers) after approvals; an acknowledged blocker still fails and no longer gates."""
    fixed = with_approvals(found, approved, dismissed)
    open_blockers = fixed.withColumn("severity", F.when(F.col("rule_id").isin(list(acknowledged)), "warning").otherwise(F.col("severity")))
    return rl.table_scores(open_blockers, rl.dimension_scores(fixed))


def criticality(severity: Column, status: Column) -> Column:
    return F.when(severity == "blocker", "Critical").when(severity == "info", "Low").when(status == "fail", "High").when(status == "warn", "Medium").otherwise("Low")


def floors(spark: SparkSession) -> DataFrame:
    """(archetype, capability, floor)."""
    return spark.createDataFrame([(a, c, n) for a, (levels, _) in FLOORS.items() for c, n in levels.items()], "archetype string, capability string, floor int")


def verdicts(levels: DataFrame, gated: DataFrame) -> DataFrame:
    """(table_name, archetype, verdict, gaps) of levels (table_name, capability, level) and gated (table_name, rule_id).

    More than half of the required capabilities at level 0 are a mismatch; an open gate is a risk; a level below its floor
    a condition. Capabilities that were not measured count for nothing.
    """
    spark = levels.sparkSession
    tables = levels.select("table_name").distinct()
    required = tables.join(F.broadcast(floors(spark))).join(levels, ["table_name", "capability"], "left")
    per = required.groupBy("table_name", "archetype").agg(
        F.count(F.lit(1)).alias("required"), F.count_if(F.col("level") == 0).alias("zeros"), F.count_if(F.col("level") < F.col("floor")).alias("gaps")
    )
    gates = spark.createDataFrame([(a, g) for a, (_, gates) in FLOORS.items() for g in gates], "archetype string, rule_id string")
    closed = gated.join(F.broadcast(gates), "rule_id").select("table_name", "archetype").distinct().withColumn("gate", F.lit(True))
    verdict = F.when(F.col("zeros") > F.col("required") / 2, "Purpose Mismatch").when(F.col("gate"), "At Risk").when(F.col("gaps") > 0, "Conditional").otherwise("Ready")
    return per.join(closed, ["table_name", "archetype"], "left").select("table_name", "archetype", verdict.alias("verdict"), "gaps")


def sample_percent(rows: int, limit: int) -> float:
    """The share of a table to sample for about `limit` rows, with half as many again."""
    return max(0.01, min(100.0, limit * 1.5 / rows * 100)) if rows else 100.0


def block_sample(df: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """About `limit` rows and not more, without an order: a fraction of every partition."""
    return df.sample(fraction=sample_percent(df.count(), limit) / 100, seed=seed).limit(limit)


def order_columns(df: DataFrame, key: list[str] = ()) -> list[str]:
    """What a table's sample is ordered by: its key, else all columns with an order."""
    return list(key) or [f.name for f in df.schema if f.dataType.typeName() not in UNORDERED]


def catalogued_count(df: DataFrame, table_name: str | None = None) -> int:
    """The row count that the catalog's statistics hold for a table, if above zero; else counted."""
    spark = df.sparkSession
    if table_name is not None and spark.catalog.tableExists(table_name):
        for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table_name}").where("col_name = 'Statistics'").collect():
            for part in row["data_type"].split(","):
                if part.strip().endswith("rows") and int(part.split()[0]) > 0:
                    return int(part.split()[0])
    return df.count()


def annotated(profile: DataFrame) -> DataFrame:
    """(table_name, column_name, semantic_type, pii_class, pii_confidence, temporal_role, is_target, is_leak) from names and dtypes alone."""
    name = lambda pattern: F.col("column_name").rlike(ANNOTATIONS[pattern])
    direct, quasi, dated = name("direct"), name("quasi"), F.col("dtype") == "datetime"
    return profile.select(
        "table_name", "column_name", F.when(direct, "identifier").when(quasi, "quasi_identifier").otherwise(F.col("dtype")).alias("semantic_type"),
        F.when(direct, "direct").when(quasi, "quasi").otherwise("none").alias("pii_class"), F.when(direct, 0.85).when(quasi, 0.70).otherwise(0.95).alias("pii_confidence"),
        F.when(dated & name("load"), "load").when(dated & name("event"), "event").otherwise("none").alias("temporal_role"), (name("target") & ~dated).alias("is_target"), name("leakage").alias("is_leak"),
    )


def escalated(fields: DataFrame) -> DataFrame:
    """fields (table_name, field_id, severity, status, value, covered) with effective severity and the escalation behind it.

    A trigger that is absent, or has no row, counts as the worst case. One window over the few fields of each table.
    """
    value = F.lower(F.trim("value"))
    tests = {"B13": F.col("covered") > 0, "B7": value == "critical", "O3": (F.col("value") != "") & (value != "full_refresh"), "B14": (F.col("value") != "") & (value != "none")}
    per_table = Window.partitionBy("table_name")
    effective, applied = F.col("severity"), F.lit(None).cast("string")
    for name, (trigger, targets, severity) in ESCALATIONS.items():
        fires = (F.col("status") == "absent") | ((F.col("status") == "present") & F.coalesce(tests[trigger], F.lit(False)))
        raised = F.coalesce(F.max(F.when(F.col("field_id") == trigger, fires)).over(per_table), F.lit(True)) & F.col("field_id").isin(targets)
        effective, applied = F.when(raised, severity).otherwise(effective), F.when(raised, name).otherwise(applied)
    return fields.withColumns({"effective": effective, "escalation": applied})


def retuned(found: DataFrame, quality: DataFrame) -> DataFrame:
    """Table scores in which the metadata dimension has the score of quality (table_name, quality), where it has one."""
    scores = rl.dimension_scores(found).join(quality, "table_name", "left")
    score = F.when((F.col("dimension") == "metadata") & F.col("quality").isNotNull(), F.bround("quality", 0)).otherwise(F.col("score"))
    return rl.table_scores(found, scores.withColumn("score", score).drop("quality"))
