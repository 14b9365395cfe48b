"""Data-quality rules: any number of row rules compiled into one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowRule:
    """A rule broken by the rows for which `broken` is true; it fails above the share `allowed`."""

    name: str
    severity: str
    broken: Column
    allowed: float = 0.0


def required(columns: list[str]) -> Column:
    """True for rows where one of the columns is null or empty."""
    missing = [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in columns]
    out = missing[0]
    for m in missing[1:]:
        out = out | m
    return out


def evaluate(df: DataFrame, rules: list[RowRule]) -> DataFrame:
    """(rule, severity, affected, items, violated): one pass over df, whatever the number of rules."""
    counts = df.agg(F.count(F.lit(1)).alias("items"), *[F.count_if(F.coalesce(r.broken, F.lit(False))).alias(f"r{k}") for k, r in enumerate(rules)])
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"r{k}").alias("affected"), F.col("items"), (F.col(f"r{k}") > r.allowed * F.col("items")).alias("violated")) for k, r in enumerate(rules)]
    return counts.select(F.inline(F.array(*rows)))


def duplicate_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """duplicate_rate: repeats among all rows."""
    groups = df.groupBy(*columns).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1) / F.sum("count"), F.lit(0.0)).alias("duplicate_rate"))


def report_score(evaluated: DataFrame) -> DataFrame:
    """score: 1 less the affected shares, errors counted twice."""
    hit = lambda s: F.sum(F.when(F.col("violated") & (F.col("severity") == s), F.col("affected")).otherwise(0))
    return evaluated.agg(F.greatest(F.lit(0.0), 1 - (2 * hit("error") + hit("warning")) / (2 * F.greatest(F.max("items"), F.lit(1)))).alias("score"))


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value, passed) of thresholds (metric, low, high): inclusive; a metric that is missing fails."""
    joined = thresholds.join(metrics, "metric", "left")
    fits = F.coalesce(F.col("value") >= F.col("low"), F.col("low").isNull()) & F.coalesce(F.col("value") <= F.col("high"), F.col("high").isNull())
    return joined.select("metric", "value", (F.col("value").isNotNull() & fits).alias("passed"))


def content_hash(df: DataFrame, column: str) -> DataFrame:
    """data_hash: 16 hex digits of the sorted identifiers.

    Identifiers are hashed where they are and the digests summed, so that no task holds them all; equal sets of rows give
    equal sums in any order.
    """
    digest = F.conv(F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.substring(F.sha2(F.concat_ws("|", F.sum(digest).cast("string"), F.count(F.lit(1)).cast("string")), 256), 1, 16).alias("data_hash"))


def compliance(rules: DataFrame, violations: DataFrame, start: str, end: str, framework: str | None = None) -> DataFrame:
    """One row: the rules made in a period, the active ones, violations in it of any known rule, and the active share x 100.

    framework keeps only rules with that tag. Rules are few; violations are counted before they meet them.
    """
    within = F.col("created").between(start, end)
    scope = rules.where(within & (F.array_contains("tags", framework) if framework else F.lit(True)))
    counted = violations.where(within).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).join(rules.select("rule_id"), "rule_id", "left_semi")
    totals = scope.agg(F.count(F.lit(1)).alias("total_rules"), F.count_if(F.col("status") == "active").alias("active_rules"))
    broken = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    share = F.coalesce(F.try_divide(F.col("active_rules") * 100.0, F.col("total_rules")), F.lit(0.0))
    return totals.join(F.broadcast(broken)).select("total_rules", "active_rules", "violations", share.cast("double").alias("score"))  # one row each


def version_counts(versions: DataFrame) -> DataFrame:
    """For each entity its versions, the active and archived ones, the latest number and the last change."""
    return versions.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "archived").alias("archived"),
        F.max("version_number").alias("latest"), F.max("created_at").alias("last_updated"),
    )


#: What a policy asks for unless it says otherwise.
THRESHOLDS = {"min_trust": 50.0, "min_secure": 90.0, "min_metadata": 80.0, "min_kb_ready": 50.0}
METRICS = ["trust", "completeness", "kb_ready", "secure", "metadata", "quality"]


def suggestions(df: DataFrame) -> DataFrame:
    """df with topics, actions, tweaks (arrays of names) and next_playbook: what to change after a policy's verdict.

    df has the METRICS and THRESHOLDS as columns, violations (array), passed and playbook. A missing metric is 0, a missing
    threshold the default; a row without any metric has the one topic no_fingerprint. Wording is left to the reader.
    """
    m = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in METRICS}
    low = {c: F.coalesce(F.col(c), F.lit(d)) for c, d in THRESHOLDS.items()}
    violations, passed = F.coalesce("violations", F.array().cast("array<string>")), F.coalesce("passed", F.lit(False))
    weak_trust, weak_kb = m["trust"] < low["min_trust"], m["kb_ready"] < F.greatest(low["min_kb_ready"], F.lit(70.0))
    other_book = F.col("playbook").isNull() | (F.upper("playbook") != "TECH")
    scanned = (m["completeness"] < 60) & (F.col("playbook").isNull() | (F.upper("playbook") == "REGULATORY"))
    broken = F.array_contains(violations, "security_not_full")
    topics = {
        "trust": weak_trust | (m["trust"] < 85), "security": broken | (m["secure"] < 100), "metadata": m["metadata"] < F.greatest(low["min_metadata"], F.lit(90.0)),
        "kb_ready": m["kb_ready"] < F.greatest(low["min_kb_ready"], F.lit(85.0)), "completeness": m["completeness"] < 90, "quality": m["quality"] < 85,
        "policy": F.when(passed, m["trust"] < 85).otherwise(F.size(violations) > 0),
    }
    actions = [
        ("quality_normalization", weak_trust & (m["quality"] < 70)), ("chunk_overlap", weak_trust & (m["completeness"] < 75)), ("composite_improvement", ~weak_trust & (m["trust"] < 70)),
        ("excellence_push", ~weak_trust & (m["trust"] >= 70) & (m["trust"] < 85)), ("metadata_extraction", m["metadata"] < F.greatest(low["min_metadata"], F.lit(85.0))), ("playbook", weak_kb & other_book), ("playbook", scanned),
        ("chunk_overlap", m["completeness"] < 75), ("quality_normalization", m["quality"] < 85), ("error_correction", m["quality"] < 85), ("excellence_push", passed & (m["trust"] < 85)),
    ]
    tweaks = [("redaction_strict", broken), ("force_metadata_extraction", m["metadata"] < low["min_metadata"]), ("increase_chunk_overlap", m["completeness"] < 75)]
    named = lambda pairs: F.array_compact(F.array(*[F.when(test, name) for name, test in pairs]))
    empty, none = F.coalesce(*METRICS).isNull(), F.array().cast("array<string>")
    found = named(topics.items())
    return df.withColumns({
        "topics": F.when(empty, F.array(F.lit("no_fingerprint"))).when(F.size(found) == 0, F.array(F.lit("monitor"))).otherwise(found), "actions": F.when(empty, none).otherwise(named(actions)),
        "tweaks": F.when(empty, none).otherwise(named(tweaks)), "next_playbook": F.when(~empty & scanned, "SCANNED").otherwise(F.col("playbook")),
    })
