"""The rule catalogue over profiles, and the roll-up to dimensions, tables and schemas.

A table's profile is reduced to one row of facts in a single aggregation; every rule is then a CASE over that row. Both
are SQL expressions, so that Catalyst compiles all rules of all tables into one projection. `matches` renders a regular
expression test in the dialect at hand.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name patterns of the rules.
PATTERNS = {
    "audit": r"(?i)^(create(?:d)?|update(?:d)?|modif(?:y|ied)|last(?:_.+)?)(?:(?:_on|_at|_date|_time|_dt|_ts)|d)?$",
    "target": r"(?i)^(label|target|outcome|class|y|status)(_.+)?$",
    "pii": r"(?i)(email|ssn|sin|phone|mobile|address|dob|birth|first_?name|last_?name|full_?name|patient_?name|member_?name|employee_?name|contact_?name|hcp_?name|provider_?name|prescriber_?name|physician_?name|doctor_?name|clinician_?name|mrn|patient_id|insurance|credit_?card|npi)",
    "consent": r"(?i)(consent|authorized|opt_?in|gdpr|hipaa)",
    "temporary": r"(?i)(_tmp$|_temp$|_v\d+$|_old$|_bak$|test_)",
    "post_event": r"(?i)(_outcome$|_result$|after_|post_|_resolved|_resolution|_followup|_final)",
    "created": r"(?i)(creat|insert|open|start|register)",
    "updated": r"(?i)(updat|modif|chang|edit|last_)",
    "watermark": r"(?i)(^(id|pk)$|_id$|_seq$|sequence$|batch_id|load_date|etl_|insert(ed)?_(at|date|ts|time)|load(ed)?_(at|date|ts|time)|ingestion_(date|time|ts)|created_(at|date|ts|time)|updated_(at|date|ts|time)|modified_(at|date|ts|time))",
    "snake": r"^[a-z][a-z0-9_]*$",
}
CADENCE = r"(?i)(daily|weekly|monthly|hourly|real[- ]?time|streaming|batch|every\s+\d+\s+(hour|minute|day|week)s?|\d+x?\s*/?\s*(day|week|month|hour)|cron|scheduled|nightly|bi-?weekly|quarterly|annual)"
WEIGHTS = {"schema": 10, "quality": 20, "labels": 15, "temporal": 15, "features": 10, "stats": 10, "privacy": 10, "metadata": 5, "ops": 5}
LENSES = {"schema": ["DQ", "AI"], "quality": ["DQ", "ML"], "labels": ["ML", "AI"], "temporal": ["DQ", "ML", "AI"], "features": ["ML", "AI"], "stats": ["DQ", "ML"], "privacy": ["DQ", "AI"], "metadata": ["DQ", "AI"], "ops": ["DQ", "AI"]}

NUMERIC, TARGET = "dtype IN ('int', 'float')", "({target} AND dtype <> 'datetime')"
MARK = "({watermark} AND dtype = 'datetime' AND null_pct < 1)"
INTERVAL = "CASE WHEN unique_count > 1 AND latest > earliest THEN ({latest} - {earliest}) / (unique_count - 1) END"
QUASI = "CASE WHEN dtype IN ('string', 'object') AND unique_count BETWEEN 2 AND 50 AND NOT {pii} THEN unique_count END"

#: One aggregate each, over the rows of a profile. {name} is a test of the column's name, {latest} seconds since 1970.
FACTS = {
    "n": "max(row_count)", "cols": "count(*)", "missing": "avg(null_count / greatest(row_count, 1.0)) * 100",
    "exact_key": "bool_or(null_count = 0 AND unique_count = row_count AND row_count > 0)", "near_key": "bool_or(null_pct < 1 AND unique_count >= 0.99 * row_count AND row_count > 0)",
    "unique_key": "bool_or(null_count = 0 AND unique_count >= 0.999 * row_count AND row_count > 0)", "audit": "count_if({audit} OR dtype = 'datetime')", "off_names": "count_if(NOT {snake})",
    "heavy_nulls": "count_if(null_pct > 50)", "surrogates": "count_if(surrogate_null_count > 0)", "targets": f"count_if({TARGET})",
    "binary_columns": f"count_if(unique_count = 2 AND null_pct < 10 AND NOT {NUMERIC})", "classes": f"min_by(unique_count, CASE WHEN {TARGET} THEN ordinal END)",
    "suspects": "count_if({post_event} AND NOT {target})", "dates": "count_if(dtype = 'datetime')", "ranges": "count_if(earliest IS NOT NULL)",
    "span": "max(floor(({latest} - {earliest}) / 86400.0))", "age": "min(days_since_latest)",
    "first_created": "max(CASE WHEN {created} THEN {earliest} END)", "first_updated": "min(CASE WHEN {updated} THEN {earliest} END)",
    "intervals": f"count({INTERVAL})", "interval_ratio": f"max({INTERVAL}) / min({INTERVAL})", "wide_categories": "count_if(dtype IN ('string', 'object', 'bool') AND unique_count > 50 AND unique_count > 0.5 * row_count)",
    "numbers": f"count_if({NUMERIC})", "infinite": "count_if(infinite_count > 0)", "constants": "count_if(unique_count <= 1 AND row_count > 1 AND NOT {audit})",
    "spread": f"count_if({NUMERIC} AND abs(mean) > 0 AND std > 3 * abs(mean))", "measured": f"count_if({NUMERIC} AND std IS NOT NULL AND mean IS NOT NULL)", "skewed": "count_if(abs(skew) > 3)",
    "pii_names": "count_if({pii})", "consents": "count_if({consent})", "temporary_names": "count_if({temporary})", "quasi": f"count({QUASI})",
    "watermarks": f"count_if({{watermark}} AND (dtype = 'datetime' AND null_pct < 1 OR {NUMERIC} AND null_pct = 0 AND unique_count >= 0.99 * row_count AND row_count > 0))",
    "texts": "count_if(dtype IN ('string', 'object') AND unique_count > 50)",
    "mark_distinct": f"min_by(unique_count, CASE WHEN {MARK} THEN ordinal END)",
}

#: What facts cannot be read from a profile: (fact, value where nothing was measured).
MEASURED = {"dup_rows": 0, "near_constant": 0, "mismatched": 0, "co_missing": 0, "phik_pairs": 0, "pearson_pairs": 0, "pii_values": 0, "entries": 0, "matched": 0, "documented": 0, "coverage": 0.0, "dictionary_mismatches": 0, "approved": 0, "denied": 0, "cadence_known": 0, "quasi_product": 0}


def ladder(*steps: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{status}'" for status, test in steps) + f" ELSE '{otherwise}' END"


def passes(test: str, otherwise: str) -> str:
    return ladder(("pass", test), otherwise=otherwise)


#: rule id: (severity, status).
RULES = {
    "schema_pk": ("warning", ladder(("pass", "exact_key"), ("warn", "near_key"), otherwise="fail")),
    "schema_audit": ("info", ladder(("pass", "audit >= 2"), ("warn", "audit = 1"), otherwise="fail")),
    "schema_col_count": ("info", passes("cols BETWEEN 5 AND 100", "warn")),
    "schema_naming": ("info", ladder(("pass", "off_names = 0"), ("warn", "off_names <= 2"), otherwise="fail")),
    "quality_rowcount": ("warning", ladder(("pass", "n >= 1000"), ("warn", "n >= 100"), otherwise="fail")),
    "quality_missing": ("warning", ladder(("pass", "missing < 5"), ("warn", "missing < 20"), otherwise="fail")),
    "quality_duplicates": ("warning", ladder(("pass", "dup_rows = 0"), ("warn", "dup_rows < 0.01 * n"), otherwise="fail")),
    "quality_col_nulls": ("warning", ladder(("pass", "heavy_nulls = 0"), ("warn", "heavy_nulls <= 2"), otherwise="fail")),
    "quality_surrogates": ("info", passes("surrogates = 0", "warn")),
    "quality_pk_uniqueness": ("warning", ladder(("pass", "exact_key"), ("warn", "unique_key"), otherwise="fail")),
    "quality_type_consistency": ("info", passes("dictionary_mismatches = 0", "warn")),
    "labels_target": ("warning", ladder(("pass", "targets > 0"), ("warn", "binary_columns > 0"), otherwise="fail")),
    "labels_balance": ("warning", ladder(("fail", "targets > 0 AND classes < 2"), otherwise="warn")),
    "labels_timestamps": ("warning", passes("dates > 0", "fail")),
    "labels_leakage": ("blocker", passes("targets = 0 OR suspects = 0", "deferred")),
    "labels_class_absolute": ("warning", ladder(("pass", "targets = 0"), ("fail", "classes < 2"), ("pass", "n >= 100.0 * classes"), ("warn", "n >= 30.0 * classes"), otherwise="fail")),
    "temporal_present": ("warning", passes("dates > 0", "fail")),
    "temporal_range_span": ("warning", ladder(("fail", "ranges = 0"), ("warn", "span = 0"), ("pass", "span >= 90"), ("warn", "span >= 30"), otherwise="fail")),
    "temporal_freshness": ("info", ladder(("warn", "age IS NULL"), ("pass", "age <= 90"), ("warn", "age <= 365"), otherwise="fail")),
    "temporal_ordering": ("info", ladder(("warn", "first_updated < first_created"), otherwise="pass")),
    "temporal_granularity": ("info", ladder(("warn", "intervals >= 2 AND interval_ratio > 100"), otherwise="pass")),
    "features_cardinality": ("warning", ladder(("pass", "wide_categories = 0"), ("warn", "wide_categories = 1"), otherwise="fail")),
    "features_numeric": ("info", ladder(("pass", "numbers >= 3"), ("warn", "numbers >= 1"), otherwise="fail")),
    "features_near_constant": ("warning", passes("near_constant = 0", "warn")),
    "features_infinites": ("warning", passes("infinite = 0", "warn")),
    "features_type_mismatch": ("info", passes("mismatched = 0", "warn")),
    "features_missingness_pattern": ("info", passes("co_missing = 0", "warn")),
    "features_mixed_correlation": ("info", passes("phik_pairs = 0", "warn")),
    "stats_no_constants": ("info", passes("constants = 0", "warn")),
    "stats_outliers": ("info", passes("measured > 0 AND spread = 0", "warn")),
    "stats_baseline": ("info", "'warn'"),
    "stats_multicollinearity": ("info", passes("pearson_pairs = 0", "warn")),
    "stats_outlier_skew": ("info", passes("skewed = 0", "warn")),
    "privacy_column_names": ("blocker", passes("pii_names = 0", "fail")),
    "privacy_values": ("warning", passes("pii_values = 0", "deferred")),
    "privacy_consent": ("warning", passes("consents > 0", "warn")),
    "privacy_k_anonymity": ("info", passes("quasi < 2 OR quasi_product <= 2 * n", "warn")),
    "metadata_dictionary": ("info", ladder(("warn", "entries = 0"), ("pass", "coverage >= 80"), ("warn", "coverage >= 40"), otherwise="fail")),
    "metadata_recon_rate": ("info", ladder(("warn", "entries = 0"), ("pass", "matched >= 0.95 * entries"), ("warn", "matched >= 0.70 * entries"), otherwise="fail")),
    "metadata_consent_approval": ("warning", ladder(("pass", "approved > 0"), ("fail", "denied > 0"), otherwise="warn")),
    "metadata_doc_coverage": ("warning", ladder(("pass", "documented >= 0.90 * cols"), ("warn", "documented >= 0.50 * cols"), otherwise="fail")),
    "ops_stable_names": ("info", passes("temporary_names = 0", "warn")),
    "ops_cadence": ("info", passes("cadence_known > 0", "warn")),
    "ops_watermark": ("info", passes("watermarks > 0", "warn")),
    "ops_partition": ("info", passes("n < 1000000", "deferred")),
    "ops_watermark_monotonic": ("info", passes("mark_distinct >= 0.95 * n", "warn")),
}


def facts_sql(matches: Callable[[str], str], seconds: Callable[[str], str]) -> dict[str, str]:
    names = {k: matches(p) for k, p in PATTERNS.items()} | {"latest": seconds("latest"), "earliest": seconds("earliest")}
    return {fact: expression.format(**names) for fact, expression in FACTS.items()}


def in_spark(pattern: str) -> str:
    return "column_name rlike '" + pattern.replace("\\", "\\\\") + "'"


def facts(profile: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """One row for each table_name of the profile: FACTS, and MEASURED from rows (table_name, fact, value) where there are any."""
    expressions = facts_sql(in_spark, lambda c: f"cast(unix_timestamp({c}) as double)")
    top = profile.withColumn("__q", F.expr(QUASI.format(pii=in_spark(PATTERNS["pii"]))))
    place = F.row_number().over(Window.partitionBy("table_name").orderBy(F.desc_nulls_last("__q"), "ordinal"))
    # the three widest quasi-identifiers of a table multiply; a profile has a row for each column only
    top = top.withColumn("__p", F.when(place <= 3, F.col("__q")))
    found = top.groupBy("table_name").agg(*[F.expr(e).alias(f) for f, e in expressions.items()], F.coalesce(F.product("__p"), F.lit(0)).alias("quasi_product"))
    rest = {k: v for k, v in MEASURED.items() if k != "quasi_product"}
    if measured is None:
        return found.withColumns({k: F.lit(v) for k, v in rest.items()})
    wide = measured.groupBy("table_name").agg(*[F.max(F.when(F.col("fact") == k, F.col("value"))).alias(k) for k in rest])
    return found.join(wide, "table_name", "left").withColumns({k: F.coalesce(k, F.lit(v)).cast("double") for k, v in rest.items()})


def checks(table_facts: DataFrame) -> DataFrame:
    """(table_name, dimension, rule_id, severity, status) of every rule; a table without labels skips that dimension."""
    rows = [F.struct(F.lit(r.split("_")[0]).alias("dimension"), F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.expr(e).alias("status")) for r, (s, e) in RULES.items()]
    return table_facts.select("table_name", "targets", "binary_columns", F.inline(F.array(*rows))).where("dimension <> 'labels' OR targets > 0 OR binary_columns > 0").drop("targets", "binary_columns")


def dimension_scores(found: DataFrame) -> DataFrame:
    """(table_name, dimension, weight, score): 100 x the mean of pass 1, warn 0.5 and fail 0, halves to even; 0 if all are deferred."""
    points = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).when(F.col("status") == "fail", 0.0)
    weight = reduce(lambda e, kv: e.when(F.col("dimension") == kv[0], kv[1]), WEIGHTS.items(), F.when(F.lit(False), 0))
    return found.groupBy("table_name", "dimension").agg(F.coalesce(F.bround(F.avg(points) * 100, 0), F.lit(0.0)).alias("score")).withColumn("weight", weight)


def tier(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 60, "yellow").otherwise("red")


def table_scores(found: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(table_name, score, tier, klass, blockers): the weighted mean of the dimensions, at most 59 if a blocker failed."""
    blockers = found.groupBy("table_name").agg(F.count_if((F.col("severity") == "blocker") & (F.col("status") == "fail")).alias("blockers"))
    raw = (scores or dimension_scores(found)).groupBy("table_name").agg(F.bround(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 0).alias("raw"))
    out = raw.join(blockers, "table_name").withColumn("score", F.when(F.col("blockers") > 0, F.least("raw", F.lit(59.0))).otherwise(F.col("raw")))
    klass = F.when(F.col("blockers") > 0, "gated").when(F.col("score") >= 80, "ready").otherwise("conditional")
    return out.select("table_name", "score", tier(F.col("score")).alias("tier"), klass.alias("klass"), "blockers")


def worst_checks(found: DataFrame) -> DataFrame:
    """(rule_id, status, tables): over tables, the worst status of each rule: deferred, fail, warn, pass."""
    rank = F.when(F.col("status") == "deferred", 3).when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    return found.groupBy("rule_id").agg(F.max_by("status", rank).alias("status"), F.count_if(F.col("status") != "pass").alias("tables"))


def lens_scores(found: DataFrame) -> DataFrame:
    """(lens, passed, total): rules that are not deferred, under each lens of their dimension."""
    lens = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in LENSES.items() for x in kv])[F.col("dimension")]
    return found.where("status <> 'deferred'").select(F.explode(lens).alias("lens"), "status").groupBy("lens").agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count(F.lit(1)).alias("total"))


def finding_uid(table: Column, rule: Column, columns: Column) -> Column:
    """A stable id of a finding: 12 hex digits."""
    return F.substring(F.sha1(F.concat_ws("|", table, rule, F.array_join(F.array_sort(columns), "|"))), 1, 12)


def simulate(found: DataFrame, rule: str) -> DataFrame:
    """(table_name, before, after): the score if the rule passed."""
    fixed = found.withColumn("status", F.when(F.col("rule_id") == rule, "pass").otherwise(F.col("status")))
    before, after = (table_scores(x).select("table_name", F.col("score").alias(c)) for x, c in ((found, "before"), (fixed, "after")))
    return before.join(after, "table_name")
