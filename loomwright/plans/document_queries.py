"""The path from documents to scored chunks, with settings of every kind among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import document_pipeline as dp
from loomwright.plans.registry import Registry, table

R = Registry()
#: What the rows say of their settings, in SQL that both engines read: by hand, resolved well and badly, detected, playbooks.
GIVEN = {
    "mode": "CASE doc_id % 6 WHEN 0 THEN 'manual' WHEN 1 THEN 'auto' WHEN 2 THEN 'auto' WHEN 3 THEN 'auto' WHEN 4 THEN 'playbook' END",
    "manual_size": "CASE WHEN doc_id % 12 = 0 THEN 120 WHEN doc_id % 18 = 1 THEN 90 END",
    "manual_overlap": "CASE WHEN doc_id % 12 = 0 THEN 20 WHEN doc_id % 18 = 6 THEN 40 WHEN doc_id % 30 = 2 THEN 500 END",
    "manual_strategy": "CASE WHEN doc_id % 24 = 6 THEN 'Semantic' WHEN doc_id % 24 = 12 THEN 'fixed_size' WHEN doc_id % 24 = 18 THEN 'other' END",
    "resolved_size": "CASE WHEN doc_id % 6 = 1 THEN 150 WHEN doc_id % 6 = 2 THEN 20000 END",
    "resolved_overlap": "CASE WHEN doc_id % 6 = 1 THEN 30 END",
    "resolved_strategy": "CASE doc_id % 18 WHEN 1 THEN 'paragraph_boundary' WHEN 7 THEN 'recursive' WHEN 13 THEN 'sentence' WHEN 2 THEN 'semantic' END",
    "resolved_kind": "CASE WHEN doc_id % 6 IN (1, 2) THEN 'legal' END",
    "resolved_confidence": "CASE doc_id % 6 WHEN 1 THEN 0.9 WHEN 2 THEN 0.4 END",
    "threshold": "CASE WHEN doc_id % 36 = 2 THEN 0.3 END",
    "playbook": "CASE doc_id % 7 WHEN 0 THEN ' Legal ' WHEN 1 THEN 'E-commerce' WHEN 2 THEN 're_tail' WHEN 3 THEN 'unheard of' WHEN 4 THEN 'REGULATORY' END",
    "extension": "CASE WHEN doc_id % 5 = 0 THEN '.md' END",
    "enhance": "doc_id % 3 = 0",
    "correct": "doc_id % 4 = 0",
}


def given(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "concat(source, '_', doc_id) AS stem", "text", *[f"CAST({e} AS {dp.GIVEN[n]}) AS {n}" for n, e in GIVEN.items()])


BOOKS = ", ".join(f"('{name}', '{values[0]}', {values[1]}, {values[2]}, {values[3]})" for name, values in dp.PLAYBOOKS.items())
WAYS = ", ".join(f"('{a}', '{b}')" for a, b in dp.STRATEGIES.items())


@R.add("X21_playbooks", f"""WITH b(name, strategy, tokens, sentences, characters) AS (VALUES {BOOKS}), g AS (SELECT doc_id, {GIVEN['playbook']} AS given FROM documents),
n AS (SELECT doc_id, CASE WHEN lower(trim(given)) = 'legal' THEN 'legal' WHEN given = 'E-commerce' THEN 'ecommerce' WHEN given = 're_tail' THEN 'retail' WHEN given = 'REGULATORY' THEN 'regulatory' ELSE 'tech' END AS name FROM g)
SELECT doc_id, name, strategy, CAST(tokens AS INTEGER) AS tokens, CAST(sentences AS INTEGER) AS sentences, CAST(characters AS INTEGER) AS characters FROM n JOIN b USING (name)""")  # fmt: skip
def playbooks(spark, sf_dir):
    named = given(spark, sf_dir).select("doc_id", dp.playbook_name(F.col("playbook")).alias("name"))
    return named.withColumn("s", dp.playbook_settings(F.col("name"))).select("doc_id", "name", "s.strategy", "s.tokens", "s.sentences", "s.characters")


# Detection has its own SQL (X16, X17); the others are resolved here.
@R.add("X22_settings", f"""WITH b(name, p_way, p_tokens, p_sentences, p_characters) AS (VALUES {BOOKS}), w(given_way, way) AS (VALUES {WAYS}), g AS (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in GIVEN.items())} FROM documents),
n AS (SELECT *, CASE WHEN lower(trim(playbook)) = 'legal' THEN 'legal' WHEN playbook = 'E-commerce' THEN 'ecommerce' WHEN playbook = 're_tail' THEN 'retail' WHEN playbook = 'REGULATORY' THEN 'regulatory' ELSE 'tech' END AS name FROM g),
h AS (SELECT doc_id, 'manual' AS source, lower(coalesce(manual_strategy, p_way)) AS way, coalesce(manual_size, p_tokens) AS size, coalesce(manual_overlap, 200) AS lap, p_way, p_sentences, p_characters, resolved_kind AS kind FROM n JOIN b USING (name) WHERE mode = 'manual'),
a AS (SELECT *, CASE WHEN manual_overlap >= size THEN size - 1 WHEN manual_overlap IS NULL THEN least(coalesce(resolved_overlap, 200), size - 1) ELSE manual_overlap END AS lap FROM (
  SELECT doc_id, 'product_auto' AS source, coalesce(manual_strategy, CASE WHEN resolved_confidence < coalesce(threshold, 0.7) THEN 'fixed_size' ELSE coalesce(resolved_strategy, 'fixed_size') END) AS way, coalesce(manual_size, resolved_size) AS size, manual_overlap, resolved_overlap, p_way,
    CASE WHEN resolved_confidence < coalesce(threshold, 0.7) THEN 'general' ELSE resolved_kind END AS kind FROM n JOIN b USING (name) WHERE mode = 'auto' AND resolved_size IS NOT NULL)),
r AS (SELECT doc_id, source, coalesce(w.way, p_way) AS strategy, kind, size, lap AS overlap, size AS tokens, greatest(1, lap // 20) AS sentences, lap * 4 AS characters FROM h LEFT JOIN w ON w.given_way = h.way
UNION ALL SELECT doc_id, source, coalesce(w.way, p_way), kind, size, lap, CASE WHEN size > 10000 THEN 4000 ELSE size END, greatest(1, lap // 20), CASE WHEN lap > 0 THEN lap * 4 ELSE 300 END FROM a LEFT JOIN w ON w.given_way = a.way
UNION ALL SELECT doc_id, 'playbook_default', p_way, resolved_kind, p_tokens, p_sentences * 20, p_tokens, p_sentences, p_characters FROM n JOIN b USING (name) WHERE mode = 'playbook')
SELECT doc_id, source, strategy, kind, CAST(size AS INTEGER) AS size, CAST(overlap AS INTEGER) AS overlap, CAST(tokens AS INTEGER) AS tokens, CAST(sentences AS INTEGER) AS sentences, CAST(characters AS INTEGER) AS characters FROM r""")  # fmt: skip
def settings(spark, sf_dir):
    """Of documents whose settings do not rest on what is detected in their texts."""
    known = dp.resolved_settings(given(spark, sf_dir)).where("mode IN ('manual', 'playbook') OR mode = 'auto' AND resolved_size IS NOT NULL")
    return known.select("doc_id", *[F.col(f"settings.{c}").alias(c) for c in ("source", "strategy", "kind", "size", "overlap", "tokens", "sentences", "characters")])


AUDIENCES = [("english", r"\bthe\b"), ("french", r"\bde\b")]


@R.add("X28_chunk_records")
def chunk_records(spark, sf_dir):
    """Every document's records; the tests hold them against a plain version."""
    found = dp.chunk_records(given(spark, sf_dir), AUDIENCES)
    return found.withColumn("text", F.md5("text"))


@R.add("X28_document_stats")
def document_stats(spark, sf_dir):
    return dp.document_stats(dp.chunk_records(given(spark, sf_dir), AUDIENCES))


@R.add("C15_chunk_trust")
def chunk_trust(spark, sf_dir):
    """Scores of every chunk, by kind of content."""
    scored = dp.scored_chunks(dp.chunk_records(given(spark, sf_dir), AUDIENCES))
    return scored.groupBy("domain_type", "strategy").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("AI_Trust_Score"), 4).alias("trust"), F.round(F.avg("Metadata_Presence"), 4).alias("metadata_presence"), F.round(F.avg("noise_score"), 4).alias("noise"))


QUERIES, ORACLE = R.queries, R.oracle
