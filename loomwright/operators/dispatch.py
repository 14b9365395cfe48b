"""Rules and policies by type, each isolated: one that cannot be compiled or that fails becomes an ERROR beside the others.

Rule types are a registry of functions from a rule's parameters to the condition of a broken row. Every condition is analysed
on its own, without a job; those that are sound are counted in one pass over the data. Should that pass fail at run time,
each rule is counted alone, so that only the ones at fault are lost.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.quality_rules import required

#: What a rule's parameters may go wrong with, besides what Spark reports.
FAULTS = (PySparkException, KeyError, TypeError, ValueError)
REPORT = "rule string, rule_type string, severity string, affected long, items long, violated boolean, error string"


@dataclass(frozen=True)
class Rule:
    """A rule of a registered type; it is violated by more than the share `allowed` of broken rows."""

    name: str
    rule_type: str
    severity: str = "warning"
    parameters: Mapping[str, object] = field(default_factory=dict)
    allowed: float = 0.0


def at_least(column: str, least: float) -> Column:
    return F.col(column) < least


def between(column: str, least: float, most: float) -> Column:
    return ~F.col(column).between(least, most)


def length_between(column: str, least: int, most: int) -> Column:
    return ~F.length(column).between(least, most)


def not_matching(column: str, pattern: str) -> Column:
    return F.col(column).rlike(pattern)


def condition(broken: str) -> Column:
    return F.expr(broken)


#: rule type: the condition of a broken row, from the rule's parameters.
TYPES: dict[str, Callable[..., Column]] = {
    "required_fields": required, "min_value": at_least, "value_range": between, "content_length": length_between, "bad_pattern": not_matching, "condition": condition,
}


def compiled(df: DataFrame, rule: Rule) -> tuple[Column | None, str | None]:
    """The condition of a rule's broken rows over df, or why there is none; df is not read."""
    if rule.rule_type not in TYPES:
        return None, f"unknown rule type {rule.rule_type}"
    try:
        broken = TYPES[rule.rule_type](**rule.parameters)
        kind = df.select(broken.alias("broken")).schema["broken"].dataType.typeName()
    except FAULTS as fault:
        return None, told(fault)
    return (broken, None) if kind == "boolean" else (None, f"a condition of type {kind}")


def told(fault: Exception) -> str:
    """A fault in a line: Spark's error class, or the exception's name."""
    kind = fault.getCondition() if isinstance(fault, PySparkException) else None
    return kind or type(fault).__name__


def counted(df: DataFrame, broken: list[Column]) -> list[int]:
    """Rows, and broken rows by each condition; null is not broken."""
    row = df.agg(F.count(F.lit(1)), *[F.count_if(F.coalesce(b, F.lit(False))).alias(f"r{k}") for k, b in enumerate(broken)]).first()
    return list(row)


def validated(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """REPORT, a row for each rule: how many rows break it, or a severity of error with the fault. Runs when it is called.

    A fault counts as one affected row, as of a rule that could not be judged.
    """
    found: dict[int, tuple] = {}
    sound: dict[int, Column] = {}
    for k, rule in enumerate(rules):
        broken, fault = compiled(df, rule)
        if fault is None:
            sound[k] = broken
        else:
            found[k] = (None, fault)
    try:
        items, *hits = counted(df, list(sound.values()))
        found |= {k: (n, None) for k, n in zip(sound, hits, strict=True)}
    except PySparkException:
        items = df.count()
        for k, broken in sound.items():
            try:
                found[k] = (counted(df, [broken])[1], None)
            except PySparkException as fault:
                found[k] = (None, told(fault))
    rows = []
    for k, rule in enumerate(rules):
        n, fault = found[k]
        rows.append((rule.name, rule.rule_type, rule.severity, n, items, n > rule.allowed * items, None) if fault is None else (rule.name, rule.rule_type, "error", 1, items, True, fault))
    return df.sparkSession.createDataFrame(rows, REPORT)


@dataclass(frozen=True)
class Policy:
    """A policy that a resource passes unless the rule's condition holds; blocking ones stop it."""

    policy_id: str
    rule: Rule
    blocking: bool = False
    enabled: bool = True


def evaluated(resources: DataFrame, key: str, policies: list[Policy]) -> DataFrame:
    """(key, policy_id, status, blocking): passed, failed or error of every resource under each enabled policy; lazy.

    All policies are one projection. One that cannot be compiled is an error for every resource and blocks none.
    """
    rows = []
    for policy in policies:
        if policy.enabled:
            broken, fault = compiled(resources, policy.rule)
            status = F.lit("error") if fault else F.when(F.coalesce(broken, F.lit(False)), "failed").otherwise("passed")
            rows.append(F.struct(F.lit(policy.policy_id).alias("policy_id"), status.alias("status"), F.lit(policy.blocking and not fault).alias("blocking")))
    if not rows:
        return resources.select(key, F.lit("").alias("policy_id"), F.lit("").alias("status"), F.lit(False).alias("blocking")).where("false")
    return resources.select(key, F.inline(F.array(*rows)))


def summarised(results: DataFrame, key: str) -> DataFrame:
    """(key, policies, passed, failed, errors, blocked) of each resource."""
    count = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy(key).agg(
        F.count(F.lit(1)).alias("policies"), count("passed").alias("passed"), count("failed").alias("failed"), count("error").alias("errors"), F.bool_or((F.col("status") == "failed") & F.col("blocking")).alias("blocked")
    )


def isolated(parts: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The frames of the parts that can be made and analysed, and the faults of the others: tables that are gone or unreadable."""
    found, faults = {}, {}
    for name, make in parts.items():
        try:
            frame = make()
            frame.schema  # noqa: B018, analysed here
            found[name] = frame
        except FAULTS as fault:
            faults[name] = told(fault)
    return found, faults
