"""Text operators and scores over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import scores as sc
from loomwright.functions import text as tx
from loomwright.operators import chunks as ch
from loomwright.plans.registry import Registry, table

R = Registry()
WORDS = r"list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"
EMAIL, PHONE, SSN = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"(?:\+?\d[\s-]?)?(?:\(\d{3}\)|\d{3})[\s-]?\d{3}[\s-]?\d{4}", r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b"
SENTENCES = r"list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(s, chr(32) || chr(10) || chr(9) || chr(13)) <> '')"


def T():
    return F.col("text")


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def column(name: str, alias: str, expression, sql: str):
    """A query of one computed column beside doc_id."""
    R.add(name, f"SELECT doc_id, {sql} AS {alias} FROM documents")(lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", expression().alias(alias)))


column("X02_redact_pii", "redacted", lambda: F.md5(tx.redact_pii(T())), f"md5(regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL}', '[redacted_email]', 'g'), '{PHONE}', '[redacted_phone]', 'g'), '{SSN}', '[SSN]', 'g'))")
column("X03_normalizers", "normalised", lambda: F.md5(tx.normalised(T(), [(r"[ \t]+", " "), (r"!{2,}", "!"), (r"\n+", " / ")])), r"md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '!{2,}', '!', 'g'), '\n+', ' / ', 'g'))")
column("X06_slug", "slug", lambda: tx.slug(T()), "substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40)")
column("X09_space_ratio", "ratio", lambda: F.round(tx.space_ratio(T(), 1000), 6), "round(CASE WHEN length(text) > 0 THEN (length(substr(text, 1, 1000)) - length(replace(substr(text, 1, 1000), ' ', ''))) / length(substr(text, 1, 1000)) ELSE 0 END, 6)")
column("X10_token_estimate", "tokens", lambda: tx.token_estimate(T()), f"greatest(length(text) // 4, len({WORDS}))")
column("X26_mid_sentence", "cut", lambda: tx.ends_mid_sentence(T()), r"NOT regexp_matches(rtrim(text), '[.!?][\x22\x27)\]]*$') AND (NOT regexp_matches(rtrim(text), '\w$') OR length(rtrim(text)) < 20)")
column("X27_fragment", "fragment", lambda: tx.is_fragment(T()), "regexp_matches(trim(text), '^[a-z]') OR NOT regexp_matches(trim(text), '[.!?]$')")
column("X38_cost_estimate", "cost", lambda: F.round(tx.token_estimate(T()) / 1000 * 0.0003, 8), f"round(greatest(length(text) // 4, len({WORDS})) / 1000.0 * 0.0003, 8)")
column("C01_completeness", "score", lambda: sc.completeness(F.size(tx.word_list(T()))), f"CASE WHEN len({WORDS}) > 1000 THEN 100.0::DOUBLE ELSE 75.0::DOUBLE END")
column("C02_accuracy", "score", lambda: F.lit(85.0), "85.0::DOUBLE")
column("C03_secure", "score", lambda: sc.secure(T()), f"CASE WHEN regexp_matches(text, '{SSN}') OR regexp_matches(text, '{PHONE}') OR regexp_matches(text, '{EMAIL}') THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END")
column("C03_secure_parity", "score", lambda: sc.secure(T(), True), f"CASE WHEN regexp_matches(text, '{SSN}') OR regexp_matches(text, '{PHONE}') OR regexp_matches(text, '{EMAIL[4:]}') THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END")
column("C04_quality", "score", lambda: sc.readability(T()), f"""CAST(CASE WHEN length(trim(text)) < 50 THEN 40 WHEN len({WORDS}) < 20 THEN 55 WHEN len({SENTENCES}) = 0 THEN 60
  WHEN len({WORDS}) / len({SENTENCES}) < 5 THEN 60 WHEN len({WORDS}) / len({SENTENCES}) < 10 THEN 70 WHEN len({WORDS}) / len({SENTENCES}) <= 25 THEN 85 WHEN len({WORDS}) / len({SENTENCES}) <= 35 THEN 80
  WHEN len({WORDS}) / len({SENTENCES}) <= 45 THEN 70 WHEN len({WORDS}) / len({SENTENCES}) <= 60 THEN 60 ELSE 50 END AS DOUBLE)""")  # fmt: skip
column("C05_timeliness", "score", lambda: F.round(sc.timeliness(F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")), "yyyy-MM-dd")), 6),
       "round(greatest(0.0, least(100.0, (1 - date_diff('day', DATE '2022-01-01' + CAST(doc_id % 500 AS INTEGER), DATE '2023-01-01') / 365.0) * 100)), 6)")
column("C06_gpt_confidence", "score", lambda: F.lit(85.0), "85.0::DOUBLE")
column("C10_diversity", "score", lambda: F.round(sc.diversity(T()), 6), r"""round(CASE WHEN length(trim(text)) < 20 OR len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+'))) = 0 THEN 0.0 ELSE (SELECT CASE WHEN t < 0.3 THEN t / 0.3 * 50 WHEN t <= 0.7 THEN 50 + (t - 0.3) / 0.4 * 50 ELSE 100.0 END
  FROM (SELECT len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+')))) / len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+'))) AS t)) END, 6)""")  # fmt: skip
column("C12_kb_ready", "score", lambda: sc.knowledge_base_ready(T()), f"CASE WHEN len({WORDS}) > 50 AND contains(text, chr(10)) THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END")
column("C13_token_count", "score", lambda: sc.token_count(F.size(tx.word_list(T()))), f"round(least(len({WORDS}) / 1000.0, 1.0) * 100, 2)")
column("C14_alpha_penalty", "quality", lambda: F.round(F.when(sc.alpha_ratio(T()) < 0.5, sc.readability(T()) * 0.4).otherwise(sc.readability(T())), 4), f"""round((CASE WHEN {LETTERS} / greatest(length(text), 1) < 0.5 THEN 0.4 ELSE 1 END) * (CASE WHEN length(trim(text)) < 50 THEN 40 WHEN len({WORDS}) < 20 THEN 55 WHEN len({SENTENCES}) = 0 THEN 60
  WHEN len({WORDS}) / len({SENTENCES}) < 5 THEN 60 WHEN len({WORDS}) / len({SENTENCES}) < 10 THEN 70 WHEN len({WORDS}) / len({SENTENCES}) <= 25 THEN 85 WHEN len({WORDS}) / len({SENTENCES}) <= 35 THEN 80
  WHEN len({WORDS}) / len({SENTENCES}) <= 45 THEN 70 WHEN len({WORDS}) / len({SENTENCES}) <= 60 THEN 60 ELSE 50 END), 4)""")  # fmt: skip
column("C18_freshness", "score", lambda: sc.freshness((F.col("doc_id") % 400).cast("double"), F.when(F.col("doc_id") % 3 == 0, "legal").when(F.col("doc_id") % 3 == 1, "Regulatory")),
       "round(100 * pow(0.5, (doc_id % 400) / (CASE doc_id % 3 WHEN 0 THEN 180.0 WHEN 1 THEN 60.0 ELSE 365.0 END)), 2)")
column("X34_low_quality", "low", lambda: tx.low_quality(T()), f"""length(trim(text)) < 50 OR {LETTERS} / greatest(length(text), 1) < 0.5 OR (len({WORDS}) > 10 AND coalesce(list_max(map_values(list_histogram({WORDS.replace('text', 'lower(text)')}))), 0) > 0.3 * len({WORDS}))""".replace("list_histogram(", "list_aggregate(").replace("(text)", "(text)"))


@R.add("X11_char_chunks", """
SELECT doc_id, CAST(s / 720 AS INTEGER) AS position, md5(substr(text, s + 1, 800)) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 720)) AS s FROM documents WHERE length(text) > 0)""")  # fmt: skip
def char_chunks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(tx.char_chunks(T(), 200, 20)).alias("position", "chunk")).withColumn("chunk", F.md5("chunk"))


@R.add("X12_sentence_chunks")
def sentence_chunks(spark, sf_dir):
    return ch.sentence_chunks(docs(spark, sf_dir), 120, 1)


@R.add("X14_paragraph_chunks", r"""
SELECT doc_id, CAST(n - 1 AS INTEGER) AS position, md5(p) AS chunk FROM (
  SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (
    SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents)))""")  # fmt: skip
def paragraph_chunks(spark, sf_dir):
    return ch.paragraphs(docs(spark, sf_dir)).withColumn("chunk", F.md5("chunk"))


@R.add("X04_pages", """
SELECT doc_id, CAST(n + 1 AS INTEGER) AS page, md5(regexp_replace(substr(text, n * 500 + 1, 500), '^\\s+|\\s+$', '', 'g')) AS body
FROM (SELECT doc_id, text, unnest(range(0, length(text) // 500 + 1)) AS n FROM documents)""")  # fmt: skip
def page_split(spark, sf_dir):
    """A page mark before every 500 characters of the whole text."""
    page = lambda n: F.concat(F.lit("=== PAGE "), (n + 1).cast("string"), F.lit(" ==="), F.substring(T(), n * 500 + 1, F.lit(500)))
    marked = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 500).cast("int")), page), "")
    clean = F.transform(tx.pages(marked), lambda p: F.struct(p["page"].alias("page"), F.regexp_replace(p["body"], r"^\s+|\s+$", "").alias("body")))
    return docs(spark, sf_dir).select("doc_id", F.inline(clean)).withColumn("body", F.md5("body"))


@R.add("G07_chunk_set_quality", """
SELECT count(*) AS chunks, round(avg(length(text)), 4) AS avg_size, min(length(text)) AS min_size, max(length(text)) AS max_size, count_if(length(text) < 50) AS empties, count(*) - count(DISTINCT text) AS duplicates, count(DISTINCT source) AS documents FROM documents""")  # fmt: skip
def chunk_set_quality(spark, sf_dir):
    size = F.length("text")
    return docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(size), 4).alias("avg_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.count_if(size < 50).alias("empties"),
                                   (F.count(F.lit(1)) - F.count_distinct("text")).alias("duplicates"), F.count_distinct("source").alias("documents"))


CHUNK = f"(SELECT doc_id, source, len({WORDS}) AS words, CASE WHEN len({WORDS}) > 1000 THEN 100.0 ELSE 75.0 END AS completeness, CASE WHEN len({WORDS}) > 50 AND contains(text, chr(10)) THEN 100.0 ELSE 50.0 END AS kb_ready, CASE WHEN regexp_matches(text, '{SSN}') OR regexp_matches(text, '{PHONE}') OR regexp_matches(text, '{EMAIL}') THEN 0.0 ELSE 100.0 END AS secure FROM documents)"


def scored(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "source", F.size(tx.word_list(T())).alias("words"), sc.completeness(F.size(tx.word_list(T()))).alias("completeness"), sc.knowledge_base_ready(T()).alias("kb_ready"), sc.secure(T()).alias("secure"))


@R.add("G01_aggregate_metrics", f"SELECT round(avg(completeness), 4) AS completeness, round(avg(kb_ready), 4) AS kb_ready, round(avg(secure), 4) AS secure FROM {CHUNK}")
def aggregate_metrics(spark, sf_dir):
    return scored(spark, sf_dir).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("completeness", "kb_ready", "secure")])


@R.add("G03_fingerprint_by_source", f"SELECT source, round(avg(completeness), 4) AS completeness, round(avg(kb_ready), 4) AS kb_ready, round(avg(secure), 4) AS secure FROM {CHUNK} GROUP BY source")
def fingerprint(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("source").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("completeness", "kb_ready", "secure")])


@R.add("G04_validation_summary", f"SELECT CASE WHEN kb_ready >= 70 THEN 'ready' ELSE 'needs_work' END AS category, count(*) AS chunks, round(avg(secure), 4) AS secure FROM {CHUNK} GROUP BY 1")
def validation_summary(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.when(F.col("kb_ready") >= 70, "ready").otherwise("needs_work").alias("category")).agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("secure"), 4).alias("secure"))


@R.add("C15_trust_score", f"SELECT doc_id, round((secure * 0.15 + completeness * 0.08 + kb_ready * 0.05) / 0.28, 2) AS trust FROM {CHUNK}")
def trust_score(spark, sf_dir):
    base = scored(spark, sf_dir)
    parts = {"Secure": F.col("secure"), "Completeness": F.col("completeness"), "KnowledgeBase_Ready": F.col("kb_ready")}
    return base.select("doc_id", sc.trust(parts, sc.WEIGHTS).alias("trust"))


@R.add("V09_threshold_policy", f"SELECT source, CASE WHEN avg(secure) < 90 THEN 'failed' WHEN avg(kb_ready) < 50 THEN 'warnings' ELSE 'passed' END AS status FROM {CHUNK} GROUP BY source")
def threshold_policy(spark, sf_dir):
    means = scored(spark, sf_dir).groupBy("source").agg(F.avg("secure").alias("secure"), F.avg("kb_ready").alias("kb"))
    return means.select("source", F.when(F.col("secure") < 90, "failed").when(F.col("kb") < 50, "warnings").otherwise("passed").alias("status"))


@R.add("X20_playbook_routing", """SELECT doc_id, CASE WHEN contains(t, 'scan') OR contains(t, 'ocr') THEN 'OCR' WHEN contains(t, 'bank') OR contains(t, 'ated') THEN 'FINANCIAL' WHEN contains(t, 'the') THEN 'REGULATORY' ELSE 'TECH' END AS playbook FROM (SELECT doc_id, lower(substr(text, 1, 1000)) AS t FROM documents)""")
def playbook_routing(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", ch.routed(F.substring(T(), 1, 1000), [("OCR", ["scan", "ocr"]), ("FINANCIAL", ["bank", "ated"]), ("REGULATORY", ["the"])], "TECH").alias("playbook"))


@R.add("X23_audience", r"""SELECT doc_id, CASE WHEN greatest(a, b) = 0 THEN 'general' WHEN a >= b THEN 'english' ELSE 'french' END AS audience FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '\bthe\b')) AS a, len(regexp_extract_all(lower(text), '\bde\b')) AS b FROM documents)""")
def audience(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", ch.audience(T(), [("english", r"\bthe\b"), ("french", r"\bde\b")]).alias("audience"))


@R.add("C24_raw_baseline", f"SELECT source, round(100 * (1 - (count(*) - count(DISTINCT text)) / count(*)), 4) AS uniqueness, round(avg(CASE WHEN contains(text, chr(10)) THEN 100.0 ELSE 0.0 END), 4) AS structure FROM documents GROUP BY source")
def raw_baseline(spark, sf_dir):
    n = F.count(F.lit(1))
    return docs(spark, sf_dir).groupBy("source").agg(F.round(100 * (1 - (n - F.count_distinct("text")) / n), 4).alias("uniqueness"), F.round(F.avg(F.when(T().contains("\n"), 100.0).otherwise(0.0)), 4).alias("structure"))


QUERIES, ORACLE = R.queries, R.oracle
# A word's largest share needs a histogram: the oracle counts words in a subquery.
ORACLE["X34_low_quality"] = f"""WITH w AS (SELECT doc_id, unnest({WORDS.replace('text', 'lower(text)')}) AS w FROM documents), c AS (SELECT doc_id, max(n) AS top, sum(n) AS words FROM (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, length(trim(text)) < 50 OR {LETTERS} / greatest(length(text), 1) < 0.5 OR (coalesce(words, 0) > 10 AND coalesce(top, 0) > 0.3 * words) AS low FROM documents LEFT JOIN c USING (doc_id)"""
