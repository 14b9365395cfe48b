"""Fourteen capabilities of a table, each on a ladder of levels 0 to 4, from the statuses of its rules and its facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.rules import finding_uid

#: What an entry of a dictionary says for all of its table, and the attributes that say it.
SAYS = {"approved_use": ["ai_ml_usage_approval"], "traced": ["lineage", "source_system"], "owned": ["business_owner", "data_steward"]}
#: The rules that are a capability's evidence.
EVIDENCE = {
    "SEM": ["metadata_dictionary"], "JOIN": ["schema_pk"], "GOV": ["privacy_column_names", "privacy_values", "privacy_consent"], "AGG": ["quality_duplicates", "quality_surrogates", "schema_pk"],
    "ACC": ["ops_watermark", "ops_partition", "ops_cadence"], "FRS": ["temporal_freshness", "temporal_range_span", "temporal_present"], "LBL": ["labels_target", "labels_balance", "labels_timestamps"], "LKG": ["labels_leakage"],
    "SIG": ["features_near_constant", "features_infinites", "features_cardinality", "features_numeric"], "STA": ["stats_no_constants", "stats_outliers", "stats_multicollinearity"],
    "TMP": ["temporal_present", "temporal_ordering", "temporal_granularity"], "VOL": ["quality_rowcount"], "LIN": ["ops_cadence"], "TXT": ["features_type_mismatch", "features_missingness_pattern"],
}
READ = sorted({rule for rules in EVIDENCE.values() for rule in rules})


def steps(*pairs: tuple[Column, int | Column], otherwise: int) -> Column:
    """The level of the first test that holds."""
    return reduce(lambda e, p: e.when(p[0], p[1]), pairs, F.when(F.lit(False), otherwise)).otherwise(otherwise)


def entry_flags(entries: DataFrame) -> DataFrame:
    """(table_name, entries, SAYS): how many entries a table has and what one of them at least says."""
    some = lambda names: F.bool_or(reduce(lambda a, b: a | b, [F.coalesce(F.col(n) != "", F.lit(False)) for n in names]))
    return entries.groupBy("table_name").agg(F.count(F.lit(1)).alias("entry_rows"), *[some(names).alias(flag) for flag, names in SAYS.items()])


def ladders() -> dict[str, Column]:
    """The level of each capability, over a row with a status for every rule of READ (missing where it was not evaluated)."""
    s = {r: F.col(r) for r in READ}
    is_ = lambda rule, *statuses: s[rule].isin(*statuses)
    number = lambda rules, *statuses: reduce(lambda a, b: a + b, [is_(r, *statuses).cast("int") for r in rules])
    documented, coverage = F.col("entry_rows") > 0, F.col("coverage")
    ready = number(EVIDENCE["ACC"], "pass")
    faults = number(["features_near_constant", "features_infinites", "features_cardinality"], "warn", "fail")
    odd = number(EVIDENCE["STA"], "warn", "fail")
    traced, owned = F.col("traced"), F.col("owned")
    line = steps((~documented, 0), (~traced & ~owned, 1), (traced & owned, 3), otherwise=2)
    return {
        "SEM": steps((~documented, 0), (coverage < 40, 1), (coverage < 70, 2), (coverage < 90, 3), otherwise=4),
        "JOIN": steps((is_("schema_pk", "warn"), 1), (is_("schema_pk", "pass"), F.when(F.col("pearson_pairs") > 0, 3).otherwise(2)), otherwise=0),
        "GOV": steps((is_("privacy_column_names", "fail"), 0), (is_("privacy_values", "deferred"), 1), (is_("privacy_consent", "warn"), 2),
                     (is_("privacy_consent", "pass") & is_("privacy_column_names", "pass"), F.when(F.col("approved_use"), 4).otherwise(3)), otherwise=2),
        "AGG": steps((is_("quality_duplicates", "fail"), 0), (is_("quality_duplicates", "warn") | is_("quality_surrogates", "warn"), 1),
                     (is_("quality_duplicates", "pass") & is_("quality_surrogates", "pass") & is_("schema_pk", "pass"), 3), otherwise=2),
        "ACC": F.when(ready == 3, 4).otherwise(ready),
        "FRS": steps((is_("temporal_present", "fail"), 0), (is_("temporal_freshness", "fail"), 1), (is_("temporal_freshness", "warn"), 2),
                     (is_("temporal_freshness", "pass"), F.when(is_("temporal_range_span", "pass"), 4).otherwise(3)), otherwise=2),
        "LBL": steps((is_("labels_target", "warn"), 1), (is_("labels_target", "pass") & is_("labels_balance", "pass") & is_("labels_timestamps", "pass"), 4),
                     (is_("labels_target", "pass") & is_("labels_timestamps", "pass"), 3), (is_("labels_target", "pass"), 2), otherwise=0),
        "LKG": steps((is_("labels_leakage", "deferred"), 1), (is_("labels_leakage", "fail"), 0), (is_("labels_leakage", "pass"), 4), otherwise=3),
        "SIG": steps((faults >= 2, 0), (faults == 1, 1), (is_("features_numeric", "fail"), 1), (is_("features_numeric", "warn"), 2),
                     (is_("features_numeric", "pass") & is_("features_near_constant", "pass"), F.when(is_("features_infinites", "pass"), 4).otherwise(3)), otherwise=3),
        "STA": steps((odd >= 2, 1), (odd == 1, 2), (number(EVIDENCE["STA"], "pass") == 3, 4), otherwise=3),
        "TMP": steps((is_("temporal_present", "fail"), 0), (is_("temporal_ordering", "warn"), 1), (is_("temporal_granularity", "warn"), 2), (number(EVIDENCE["TMP"], "pass") == 3, 4), otherwise=3),
        "VOL": steps((is_("quality_rowcount", "fail"), 0), (is_("quality_rowcount", "warn"), 1), (is_("quality_rowcount", "pass") & (F.col("n") >= 10000), 4), (is_("quality_rowcount", "pass") & (F.col("n") >= 5000), 3), otherwise=2),
        "LIN": F.when((line >= 3) & is_("ops_cadence", "pass"), 4).otherwise(line),
        "TXT": steps((F.col("texts") == 0, 3), (is_("features_type_mismatch", "warn") | is_("features_missingness_pattern", "warn"), 1), otherwise=2),
    }


def capability_levels(found: DataFrame, table_facts: DataFrame, entries: DataFrame) -> DataFrame:
    """(table_name, capability, level, evidence) of checks (found), facts and a dictionary (table_name, attributes of SAYS).

    One aggregation turns the statuses of a table into columns. evidence: the ids of the findings that the level rests on;
    a rule that was not evaluated has none, as a table without long texts has none for TXT.
    """
    wide = found.groupBy("table_name").agg(*[F.coalesce(F.max(F.when(F.col("rule_id") == r, F.col("status"))), F.lit("missing")).alias(r) for r in READ])
    flags = {"entry_rows": F.lit(0), **{flag: F.lit(False) for flag in SAYS}}
    rows = wide.join(table_facts.select("table_name", "n", "coverage", "pearson_pairs", "texts"), "table_name").join(entry_flags(entries), "table_name", "left").withColumns({c: F.coalesce(c, v) for c, v in flags.items()})
    uid = lambda rule: F.when(F.col(rule) != "missing", finding_uid(F.col("table_name"), F.lit(rule), F.array().cast("array<string>")))
    levels = []
    for name, level in ladders().items():
        ids = F.array_compact(F.array(*map(uid, EVIDENCE[name])))
        ids = F.when(F.col("texts") > 0, ids).otherwise(F.array().cast("array<string>")) if name == "TXT" else ids
        levels.append(F.struct(F.lit(name).alias("capability"), level.cast("int").alias("level"), ids.alias("evidence")))
    return rows.select("table_name", F.inline(F.array(*levels)))
