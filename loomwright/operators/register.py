"""Metadata quality: a register of 44 fields that a documented table should have, scored per table.

A dictionary has one entry a column. Its entries become the register's fields in one aggregation per table: a table's field
is the first value that is not blank, in the order of the entries; a column's field is how many entries have one. Fields
are validated, escalated and scored as expressions over 44 rows a table, whatever the number of tables or entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.verdicts import escalated

# Id, name, category and severity of the fields.
REGISTER = [
    ("B1", "Business Name", "business", "HIGH"),
    ("B2", "Business Description", "business", "HIGH"),
    ("B3", "Column Business Definitions", "business", "HIGH"),
    ("B4", "Business Domain / Subject Area", "business", "HIGH"),
    ("B5", "Data Owner", "business", "HIGH"),
    ("B6", "Data Steward", "business", "MEDIUM"),
    ("B7", "Business Criticality Rating", "business", "MEDIUM"),
    ("B8", "Known Use Cases / Key Consumers", "business", "MEDIUM"),
    ("B9", "Glossary Term Linkage", "business", "MEDIUM"),
    ("B10", "Synonyms & Aliases", "business", "LOW"),
    ("B11", "Related KPIs / Metrics", "business", "LOW"),
    ("B12", "Data Classification", "business", "HIGH"),
    ("B13", "Sensitive Data Flags (PII/PHI/financial/secret)", "business", "HIGH"),
    ("B14", "Regulatory Applicability", "business", "HIGH"),
    ("B15", "Access Control Policy", "business", "HIGH"),
    ("B16", "Retention & Disposal Policy", "business", "HIGH"),
    ("B17", "Protection Requirements (Masking/Encryption)", "business", "MEDIUM"),
    ("B18", "Certification / Attestation Status", "business", "MEDIUM"),
    ("B19", "Sharing & Contractual Constraints", "business", "MEDIUM"),
    ("B20", "Audit & Traceability Requirements", "business", "MEDIUM"),
    ("B21", "Consent / Purpose Limitation", "business", "LOW"),
    ("O1", "Refresh Frequency & Load Schedule", "operational", "HIGH"),
    ("O2", "Freshness (Last Successful Load)", "operational", "HIGH"),
    ("O3", "Load Pattern & Watermark Definition", "operational", "HIGH"),
    ("O4", "DQ Checks & Latest Results", "operational", "HIGH"),
    ("O5", "SLA / Availability Expectation", "operational", "MEDIUM"),
    ("O6", "Volume Metrics & Growth Trend", "operational", "MEDIUM"),
    ("O7", "Producing Pipeline / Job Identifiers", "operational", "MEDIUM"),
    ("O8", "Incident & Failure History", "operational", "LOW"),
    ("O9", "Usage & Access Statistics", "operational", "LOW"),
    ("T1", "Physical Identifiers & Location", "technical", "HIGH"),
    ("T2", "Column Structure", "technical", "HIGH"),
    ("T3", "Primary / Unique Key Definition", "technical", "HIGH"),
    ("T4", "Foreign Keys & Join Relationships", "technical", "MEDIUM"),
    ("T5", "Data Format, Encoding & Conventions", "technical", "MEDIUM"),
    ("T6", "Partitioning / Distribution Strategy", "technical", "MEDIUM"),
    ("T7", "Value Domains / Reference Values", "technical", "MEDIUM"),
    ("T8", "Schema Version & Change History", "technical", "MEDIUM"),
    ("T9", "Cardinality Classification", "technical", "LOW"),
    ("L1", "Source System of Origin", "lineage", "HIGH"),
    ("L2", "Upstream Dataset Lineage", "lineage", "HIGH"),
    ("L3", "Transformation Logic Summary", "lineage", "MEDIUM"),
    ("L4", "Column-Level Lineage", "lineage", "MEDIUM"),
    ("L5", "Downstream Consumption Lineage", "lineage", "MEDIUM"),
]
# What stands for nothing, points by severity, the shortest description, coverage that counts and that passes a gate.
PLACEHOLDERS = ["tbd", "n/a", "todo", "-", "na", "none", "unknown", ""]
POINTS = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
LEAST_DESCRIPTION, LEAST_COVERAGE, GATES, GATE = 120, 0.5, {"B13": 1.0}, 0.95
CATEGORIES = ["business", "operational", "technical", "lineage"]

#: Attributes of an entry that give a table's field, the first that is not empty.
FIRST = {
    "B2": ["definition", "description"], "B4": ["usage_context"], "B5": ["business_owner"], "B6": ["data_steward"], "B8": ["usage_context"], "B12": ["security_classification"], "B16": ["retention_policy"],
    "B21": ["consent_basis", "ai_ml_usage_approval"], "O1": ["refresh_frequency"], "O2": ["last_synced_at"], "T3": ["primary_foreign_key"], "T4": ["primary_foreign_key"], "L1": ["source_system"], "L2": ["lineage"],
}
#: Attributes of which one covers a column.
COVERED = {"B3": ["definition"], "B13": ["pii_flag"], "T2": ["data_type_declared", "nullable_declared"], "T7": ["valid_values_range"], "T9": ["cardinality_declared"]}
ATTRIBUTES = sorted({a for names in [*FIRST.values(), *COVERED.values()] for a in names})


def bare(value: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def extracted(tables: DataFrame, entries: DataFrame) -> DataFrame:
    """(table_name, field_id, name, category, severity, place, status, value, covered, total): 44 rows for each table.

    tables (table_name, row_count, column_count); entries (table_name, position, ATTRIBUTES), in the order of position.
    """
    sums = []
    for field, names in FIRST.items():
        given = F.coalesce(*[F.nullif(F.col(a), F.lit("")) for a in names])
        fits = bare(given) != ""
        fits = fits & F.upper(given).contains("FK") if field == "T4" else fits
        sums.append(F.min_by(bare(given), F.when(fits, F.col("position"))).alias(f"v_{field}"))
    for field, names in COVERED.items():
        some = reduce(lambda a, b: a | b, [F.coalesce(bare(F.col(a)) != "", F.lit(False)) for a in names])
        sums.append(F.count_if(some).alias(f"c_{field}"))
    found = tables.join(entries.groupBy("table_name").agg(*sums), "table_name", "left")
    known = {"T1": F.col("table_name"), "O6": F.greatest("row_count", F.lit(0)).cast("string")}
    rows = []
    for place, (field, name, category, severity) in enumerate(REGISTER):
        value = known.get(field, F.col(f"v_{field}") if field in FIRST else F.lit(None).cast("string"))
        covered = F.coalesce(f"c_{field}", F.lit(0)).cast("long") if field in COVERED else F.lit(None).cast("long")
        status = F.when(covered > 0 if field in COVERED else value.isNotNull(), "present").otherwise("absent")
        total = F.col("column_count").cast("long") if field in COVERED else F.lit(None).cast("long")
        pairs = {"field_id": field, "name": name, "category": category, "severity": severity, "place": place}
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in pairs.items()], status.alias("status"), value.alias("value"), covered.alias("covered"), total.alias("total")))
    return found.select("table_name", F.inline(F.array(*rows)))


def validated(fields: DataFrame) -> DataFrame:
    """fields with valid: covered columns count from half of them on, a description from 120 characters on."""
    field, value = F.col("field_id"), F.col("value")
    share = F.when(F.col("total") == 0, 1.0).otherwise(F.col("covered") / F.col("total"))
    test = F.when(field.isin("T1", "O6"), F.lit(True)).when(F.col("status") == "absent", F.lit(False)).when(field.isin(list(COVERED)), share >= LEAST_COVERAGE)
    test = test.when(field == "B2", F.length(value) >= LEAST_DESCRIPTION).otherwise(~F.lower(bare(value)).isin(PLACEHOLDERS))
    return fields.withColumn("valid", test)


def field_quality(tables: DataFrame, entries: DataFrame) -> DataFrame:
    """The fields of every table with valid, effective (severity), escalation, state, possible and earned points."""
    found = escalated(validated(extracted(tables, entries)))
    possible = reduce(lambda e, kv: e.when(F.col("effective") == kv[0], float(kv[1])), POINTS.items(), F.when(F.lit(False), 0.0))
    share = F.coalesce(F.col("covered") / F.greatest("total", F.lit(1)), F.lit(1.0))
    state = F.when(F.col("status") == "absent", "absent").when(F.col("valid"), "present").otherwise("invalid")
    return found.withColumn("possible", possible).withColumns({"earned": F.when(F.col("valid"), F.bround(F.col("possible") * share, 2)).otherwise(0.0), "state": state})


def category_scores(fields: DataFrame) -> DataFrame:
    """(table_name, category, score, possible, earned, present, valid, fields)."""
    sums = [F.sum("possible").alias("possible"), F.bround(F.sum("earned"), 2).alias("earned"), F.count_if(F.col("state") == "present").alias("present"), F.count_if("valid").alias("valid"), F.count(F.lit(1)).alias("fields")]
    return fields.groupBy("table_name", "category").agg(F.bround(F.sum("earned") / F.sum("possible"), 4).alias("score"), *sums)


def metadata_quality(fields: DataFrame) -> DataFrame:
    """(table_name, verdict, overall, quality, high_failing): the mean of the four categories, and a verdict by gates.

    An invalid field of HIGH severity is RED, one of MEDIUM severity YELLOW. quality is overall in per cent, for R14.
    """
    gate = reduce(lambda e, kv: e.when(F.col("field_id") == kv[0], kv[1]), GATES.items(), F.when(F.lit(False), GATE)).otherwise(GATE)
    short = F.coalesce(F.col("covered") / F.greatest("total", F.lit(1)) < gate, F.lit(True))
    high, medium = (~F.col("valid") & (F.col("effective") == s) for s in ("HIGH", "MEDIUM"))
    gates = fields.groupBy("table_name").agg(F.bool_or(high & short).alias("red"), F.bool_or(medium).alias("yellow"), F.count_if(high).alias("high_failing"))
    score = category_scores(fields).groupBy("table_name").agg(*[F.max(F.when(F.col("category") == c, F.col("score"))).alias(c) for c in CATEGORIES])
    overall = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in CATEGORIES]) / 4
    verdict = F.when(F.col("red"), "RED").when(F.col("yellow"), "YELLOW").otherwise("GREEN")
    return score.join(gates, "table_name").select("table_name", verdict.alias("verdict"), *CATEGORIES, F.bround(overall, 4).alias("overall"), F.bround(overall * 100, 0).alias("quality"), "high_failing")


def remediation(fields: DataFrame) -> DataFrame:
    """(table_name, priority, field_id, effective, recoverable, owner) of invalid fields: the most severe first, then by points."""
    rank = F.when(F.col("effective") == "HIGH", 0).when(F.col("effective") == "MEDIUM", 1).otherwise(2)
    order = Window.partitionBy("table_name").orderBy(rank, F.desc("possible"), "place")
    owner = F.when(F.col("category") == "business", "business").otherwise("platform")
    return fields.where(~F.col("valid")).select("table_name", F.row_number().over(order).alias("priority"), "field_id", "effective", F.bround(F.col("possible") - F.col("earned"), 2).alias("recoverable"), owner.alias("owner"))
