"""Suggestions after a policy's verdict, fallback scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import scores as sc
from loomwright.operators import quality_rules as qr
from loomwright.plans.registry import Registry, table

R = Registry()

#: Measured sets, one a customer: every step of every ladder occurs; each ninth has no metric.
MEASURED = ", ".join(f"CASE WHEN c_custkey % 9 > 0 THEN CAST(c_custkey * {step} % 101 AS DOUBLE) END AS {metric}" for metric, step in zip(qr.METRICS, (37, 41, 43, 47, 53, 59), strict=True))
MEASURED += ", CASE WHEN c_custkey % 7 = 0 THEN CAST(75 AS DOUBLE) END AS min_trust, CAST(NULL AS DOUBLE) AS min_secure, CASE WHEN c_custkey % 5 = 0 THEN CAST(95 AS DOUBLE) END AS min_metadata, CAST(NULL AS DOUBLE) AS min_kb_ready"
MEASURED += ", c_custkey % 4 = 0 AS passed, CASE c_custkey % 3 WHEN 0 THEN 'tech' WHEN 1 THEN 'Regulatory' END AS playbook"


@R.add("V10_suggestions", f"""WITH m AS (SELECT c_custkey, {MEASURED}, c_custkey % 6 = 0 AS broken FROM customer),
d AS (SELECT c_custkey, trust IS NULL AS nothing, coalesce(min_trust, 50) AS lt, coalesce(min_metadata, 80) AS lm, trust, completeness AS c, kb_ready AS k, secure, metadata AS md, quality AS q, passed, playbook, broken FROM m)
SELECT c_custkey,
CASE WHEN nothing THEN 'no_fingerprint' ELSE coalesce(nullif(concat_ws(',', CASE WHEN trust < lt OR trust < 85 THEN 'trust' END, CASE WHEN broken OR secure < 100 THEN 'security' END, CASE WHEN md < lm OR md < 90 THEN 'metadata' END, CASE WHEN k < 85 THEN 'kb_ready' END, CASE WHEN c < 90 THEN 'completeness' END,
  CASE WHEN q < 85 THEN 'quality' END, CASE WHEN passed AND trust < 85 OR NOT passed AND broken THEN 'policy' END), ''), 'monitor') END AS topics,
CASE WHEN nothing THEN '' ELSE concat_ws(',', CASE WHEN trust < lt AND q < 70 THEN 'quality_normalization' END, CASE WHEN trust < lt AND c < 75 THEN 'chunk_overlap' END, CASE WHEN trust < lt THEN NULL WHEN trust < 70 THEN 'composite_improvement' WHEN trust < 85 THEN 'excellence_push' END,
  CASE WHEN md < lm OR md < 85 THEN 'metadata_extraction' END, CASE WHEN k < 70 AND coalesce(playbook, '') <> 'tech' THEN 'playbook' END, CASE WHEN c < 60 AND coalesce(playbook, 'Regulatory') = 'Regulatory' THEN 'playbook' END,
  CASE WHEN c < 75 THEN 'chunk_overlap' END, CASE WHEN q < 85 THEN 'quality_normalization,error_correction' END, CASE WHEN passed AND trust < 85 THEN 'excellence_push' END) END AS actions,
CASE WHEN nothing THEN '' ELSE concat_ws(',', CASE WHEN broken THEN 'redaction_strict' END, CASE WHEN md < lm THEN 'force_metadata_extraction' END, CASE WHEN c < 75 THEN 'increase_chunk_overlap' END) END AS tweaks,
CASE WHEN c < 60 AND coalesce(playbook, 'Regulatory') = 'Regulatory' THEN 'SCANNED' ELSE playbook END AS next_playbook FROM d""")  # fmt: skip
def suggestions(spark, sf_dir):
    some = table(spark, sf_dir, "customer").selectExpr("c_custkey", *MEASURED_COLUMNS, "CASE WHEN c_custkey % 6 = 0 THEN array('security_not_full') END AS violations")
    listed = {c: F.array_join(c, ",") for c in ("topics", "actions", "tweaks")}
    return qr.suggestions(some).withColumns(listed).select("c_custkey", *listed, "next_playbook")


MEASURED_COLUMNS = MEASURED.split(", ")


@R.add("C16_fallback_scores")
def fallback_scores(spark, sf_dir):
    """RE2 cannot look behind, so sentences have no SQL; the tests hold a plain version against it."""
    audience = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Dev' WHEN 1 THEN 'unknown' WHEN 2 THEN 'teachers' END")
    scored = sc.fallback_scores(F.col("text"), F.col("lang"), F.col("source"), F.col("doc_id"), audience, F.lit(None))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(scored)))


QUERIES, ORACLE = R.queries, R.oracle
