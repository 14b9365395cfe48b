"""From text to scored chunks: corrections, sections, metadata, audience, noise and the scores of sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import scores as sc
from loomwright.functions import text as tx
from loomwright.operators.quality_rules import compliance
from loomwright.operators.retrieval import conflicts
from loomwright.plans.registry import Registry, table
from loomwright.plans.text_queries import EMAIL, PHONE, SENTENCES, SSN, WORDS

R = Registry()
# RE2 knows word boundaries of ASCII only.
EDGE, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
LABELLED = "text || ' Author: Ann Smith, v1.' || doc_id || ', ' || CASE doc_id % 3 WHEN 0 THEN '03/04/2021' WHEN 1 THEN 'March 3, 2021' ELSE '2021-03-04' END"
AUDIENCE = "CASE doc_id % 4 WHEN 0 THEN 'Dev' WHEN 1 THEN 'unknown' WHEN 2 THEN 'teachers' END"
DOMAIN = "CASE doc_id % 3 WHEN 0 THEN 'regulatory' WHEN 1 THEN 'Finance' END"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def nested(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


SPACED = "length(text) > 100 AND length(substr(text, 1, 500)) - length(replace(substr(text, 1, 500), ' ', '')) > 0.3 * length(substr(text, 1, 500))"
STEPS = [(r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", ""), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"[ \t]+\n", "\n"), (r" +([,.!?;:])", r"\1"), (r"([,.!?;:])([^\s])", r"\1 \2"),
         (r"[\x{2018}\x{2019}\x{2032}]", "''"), (r"[\x{201C}\x{201D}\x{2033}]", '"'), (r"[\x{2013}\x{2014}\x{2015}]", "-"), (r"\.{4,}", "..."), (r"\n{4,}", "\n\n\n"), (r"^\s+|\s+$", "")]
# RE2 has no references back: one step a letter.
REPEATS = [(f"([{c}{c.upper()}])[{c}{c.upper()}]{{3,}}", r"\1\1") for c in "abcdefghijklmnopqrstuvwxyz"]
TYPOS = [(f"(?i)({EDGE}){wrong}({END})", rf"\1{right}\2") for wrong, right in (("teh", "the"), ("adn", "and"), ("tha", "that"), ("taht", "that"), ("hte", "the"))]


@R.add("X07_enhanced", f"SELECT doc_id, md5(CASE WHEN {SPACED} THEN text ELSE {nested('text', STEPS)} END) AS enhanced FROM documents")
def enhanced(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.enhanced(F.col("text"))).alias("enhanced"))


# Neighbours share the character between them, so a typo is replaced twice over.
@R.add("X08_corrected", f"SELECT doc_id, md5(CASE WHEN {SPACED} THEN text ELSE {nested('text', [s for t in TYPOS for s in (t, t)] + REPEATS + [('(?i)([.!?])([A-Z][a-z])', chr(92) + '1 ' + chr(92) + '2')])} END) AS corrected FROM documents")
def corrected(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.corrected(F.col("text"))).alias("corrected"))


def name_sql(title: str) -> str:
    plain = rf"lower(regexp_replace(regexp_replace({title}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"
    return f"CASE {plain} WHEN 'conclusion' THEN 'conclusions' ELSE coalesce(nullif(substr(regexp_replace({plain}, '[^a-z0-9]+', '_', 'g'), 1, 40), ''), 'section') END"


@R.add("X06_section_name", f"SELECT doc_id, {name_sql('text')} AS name FROM documents")
def section_name(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.section_name(F.col("text")).alias("name"))


@R.add("X05_sections", rf"""
WITH l AS (SELECT doc_id, i, line, regexp_matches(line, '^(An|Le) ') OR regexp_matches(line, '^(\d+)[\.\)]\s+(.+)$') OR regexp_matches(line, '^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+$')
    OR (regexp_matches(line, '^[A-Z0-9][A-Z0-9 &''\-]{{6,}}$') AND regexp_matches(line, '\S\s+\S')) AS header
  FROM (SELECT doc_id, regexp_replace(unnest(parts), '^\s+|\s+$', '', 'g') AS line, generate_subscripts(parts, 1) AS i
    FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS parts FROM documents)) WHERE line <> ''),
g AS (SELECT *, sum(header::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM l),
found AS (SELECT doc_id, s, coalesce(max(line) FILTER (header), 'Introduction') AS title, string_agg(line, chr(10) ORDER BY i) FILTER (NOT header) AS body FROM g GROUP BY doc_id, s HAVING count(*) FILTER (NOT header) > 0),
every AS (SELECT * FROM found UNION ALL SELECT doc_id, 0, 'Introduction', regexp_replace(text, '^\s+|\s+$', '', 'g') FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM found))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS position, title, {name_sql('title')} AS name, md5(body) AS body FROM every""")  # fmt: skip
def sections(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", F.posexplode(tx.sections(F.col("text"), ["(An|Le) "])).alias("position", "s"))
    return found.select("doc_id", "position", "s.title", "s.name", F.md5("s.body").alias("body"))


PLAIN = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@R.add("X19_representative_sample", f"""
SELECT doc_id, md5(CASE WHEN length(p) <= 600 THEN p ELSE substr(substr(p, 1, 150) || ' === MIDDLE SAMPLE === ' || substr(p, greatest(length(p) // 2 - 75, 0) + 1, 150) || ' === END SAMPLE === ' || right(p, 150), 1, 600) END) AS sample
FROM (SELECT doc_id, {PLAIN} AS p FROM documents)""")  # fmt: skip
def representative_sample(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.representative(F.col("text"), 150, 600)).alias("sample"))


@R.add("X25_metadata", rf"""
WITH t AS (SELECT doc_id, source, {LABELLED} AS text FROM documents),
d AS (SELECT doc_id, source, list_concat(list_concat(regexp_extract_all(text, '{EDGE}(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}){END}', 1)[1:3],
    regexp_extract_all(text, '(?i){EDGE}(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{{1,2}},?\s+\d{{4}}{END}', 1)[1:3]), regexp_extract_all(text, '{EDGE}(\d{{4}}-\d{{2}}-\d{{2}}){END}', 1)[1:3]) AS dates,
  regexp_extract(text, '(?i)(?:By|Author|Written by|Created by):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)', 1) AS author, regexp_extract_all(text, '(?i){EDGE}(v|version|ver|v\.)\s*(\d+(?:\.\d+)+){END}', 2)[1:2] AS versions FROM t)
SELECT doc_id, dates[1] AS doc_date, source || CASE WHEN len(dates) > 0 THEN '; dates:' || array_to_string(dates[1:3], ',') ELSE '' END || CASE WHEN author <> '' THEN '; author:' || author ELSE '' END
  || CASE WHEN len(versions) > 0 THEN '; versions:' || array_to_string(versions, ',') ELSE '' END AS tags FROM d""")  # fmt: skip
def metadata(spark, sf_dir):
    """Every document signs with an author, a version and a date of one of three forms."""
    return docs(spark, sf_dir).withColumn("text", F.expr(LABELLED)).select("doc_id", F.inline(F.array(tx.found_metadata(F.col("text"), F.col("source")))))


@R.add("X35_text_issues", f"""
WITH w AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents), c AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, concat_ws(', ', CASE WHEN length(text) < 50 THEN 'Too short' END, CASE WHEN len({WORDS}) < 10 THEN 'Too few words' END, CASE WHEN len({WORDS}) > 10 AND top > 0.3 * len({WORDS}) THEN 'Repetitive content' END) AS issues
FROM documents LEFT JOIN c USING (doc_id)""")  # fmt: skip
def text_issues(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(tx.text_issues(F.col("text")), ", ").alias("issues"))


@R.add("X35_score_issues", r"""
SELECT doc_id, concat_ws(', ', CASE WHEN regexp_matches(text, '^[a-z]') THEN 'starts_mid_sentence' END, CASE WHEN NOT regexp_matches(text, '[.!?]$') THEN 'ends_mid_sentence' END, CASE WHEN doc_id % 100 < 50 THEN 'low_confidence' END,
  CASE WHEN doc_id % 70 > 50 THEN 'high_noise' END, CASE WHEN n_chars % 100 < 50 THEN 'low_coherence' END) AS issues FROM documents""")  # fmt: skip
def score_issues(spark, sf_dir):
    text = F.col("text")
    found = tx.score_issues(text.rlike("^[a-z]"), ~text.rlike(r"[.!?]\z"), F.col("doc_id") % 100, F.col("doc_id") % 70, F.col("n_chars") % 100)
    return docs(spark, sf_dir).select("doc_id", F.array_join(found, ", ").alias("issues"))


@R.add("C08_metadata_presence", f"""
SELECT doc_id, least(100.0, 25.0 * ((doc_id % 7 > 2)::INTEGER + (coalesce(lang, '') <> '')::INTEGER + ({AUDIENCE} IS NOT NULL)::INTEGER + (doc_id % 5 > 0)::INTEGER)
  + 10.0 * ((lower(trim(coalesce(lang, ''))) NOT IN ('', 'general', 'unknown', 'none'))::INTEGER + (doc_id % 2)::INTEGER + (doc_id % 4 IN (0, 2))::INTEGER + (doc_id % 11 > 4)::INTEGER))::DOUBLE AS score FROM documents""")  # fmt: skip
def metadata_presence(spark, sf_dir):
    """Of records with the language as section; sources, audiences, dates, field names and ids are missing in some rows."""
    some = [F.expr(f"CASE {x} END") for x in ("WHEN doc_id % 7 > 2 THEN 'crawl' ELSE ''", "WHEN doc_id % 5 > 0 THEN '2024-01-01'", "doc_id % 2 WHEN 1 THEN 'title' ELSE ' General '", "WHEN doc_id % 11 > 4 THEN doc_id")]
    return docs(spark, sf_dir).select("doc_id", sc.metadata_presence(some[0], F.col("lang"), F.expr(AUDIENCE), *some[1:]).alias("score"))


def hits_sql(terms: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches(t, '{EDGE}{x}{END}')::INTEGER" for x in terms) + ")"


OWN = [f"least(60.0, {points} * {hits_sql(terms)})" for points, terms in sc.DOMAIN_TERMS.values()]


@R.add("C09_audience_intentionality", rf"""
WITH x AS (SELECT doc_id, text, lower(text) || ' ' || lower(coalesce(source, '')) || CASE doc_id % 5 WHEN 0 THEN ' the auditor and the bank support a developer api' WHEN 1 THEN ' your audit trail' WHEN 2 THEN ' legal counsel, made for users' ELSE '' END AS t, {DOMAIN} AS domain FROM documents),
y AS (SELECT doc_id, t, CASE domain WHEN 'regulatory' THEN {OWN[0]} WHEN 'Finance' THEN {OWN[1]} ELSE 0.0 END AS own, {" + ".join(f"least(50.0, {points} * {hits_sql(terms)})" for points, terms in sc.AUDIENCE_TERMS)} AS others FROM x)
SELECT doc_id, CAST(CASE WHEN length(regexp_replace(t, '^\s+|\s+$', '', 'g')) < 20 THEN 0 ELSE least(100.0, own + CASE WHEN own > 0 THEN others / 2 ELSE others END + CASE WHEN regexp_matches(t, '{EDGE}(?:you|your|users?|customers?|readers?|audience){END}') THEN 30 ELSE 0 END
  + CASE WHEN regexp_matches(t, '{EDGE}(?:for|intended\s+for|designed\s+for|targeted\s+to)\s+(?:the\s+)?[\p{{L}}\p{{N}}_]') THEN 20 ELSE 0 END) END AS DOUBLE) AS score FROM y""")  # fmt: skip
def audience_intentionality(spark, sf_dir):
    """Of texts to which a phrase is added that names some audience."""
    told = "concat(text, ' ', coalesce(source, ''), CASE doc_id % 5 WHEN 0 THEN ' The auditor and the bank support a developer API' WHEN 1 THEN ' Your audit trail' WHEN 2 THEN ' Legal counsel, made for users' ELSE '' END)"
    return docs(spark, sf_dir).select("doc_id", sc.audience_intentionality(F.expr(told), F.expr(DOMAIN)).alias("score"))


@R.add("C11_audience_accessibility", rf"""
WITH x AS (SELECT doc_id, {AUDIENCE} AS audience, lower(text) AS t, CASE WHEN len({SENTENCES}) > 0 THEN len({WORDS}) / len({SENTENCES}) END AS mean FROM documents)
SELECT doc_id, CAST(CASE WHEN audience IN ('Dev', 'teachers') THEN CASE audience WHEN 'Dev' THEN 85 ELSE 70 END + CASE WHEN mean BETWEEN 10 AND 20 THEN 15 WHEN mean BETWEEN 8 AND 25 THEN 10 WHEN mean BETWEEN 5 AND 30 THEN 5 ELSE 0 END
  WHEN regexp_matches(t, '{EDGE}(simple|easy|clear|straightforward|basic|example|for instance|such as|including){END}') THEN 50 ELSE 30 END AS DOUBLE) AS score FROM x""")  # fmt: skip
def audience_accessibility(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", sc.audience_accessibility(F.expr(AUDIENCE), F.col("text")).alias("score"))


NOISY = "concat(CASE doc_id % 4 WHEN 0 THEN concat('Page 3 of 9', chr(10)) ELSE '' END, text, CASE doc_id % 4 WHEN 1 THEN concat(chr(10), '  Table of Contents', chr(10), 'Confidential') WHEN 2 THEN concat(chr(10), 'Not for distribution, ever') ELSE '' END)"


# In these texts the patterns never overlap.
@R.add("C19_noise", f"""
SELECT doc_id, round_even(100.0 * coalesce(list_sum(list_transform(list_concat(list_concat(regexp_extract_all(t, '(?im)^\\s*(?:confidential|proprietary|copyright|all rights reserved)'), regexp_extract_all(t, '(?im)^\\s*page\\s+\\d+\\s+of\\s+\\d+\\s*$')),
  list_concat(regexp_extract_all(t, '(?im)^\\s*(?:table of contents|index|appendix)\\s*$'), regexp_extract_all(t, '(?im)^\\s*(?:this document is confidential|not for distribution)'))), lambda x: length(x))), 0) / length(t), 2) AS noise
FROM (SELECT doc_id, {NOISY} AS t FROM documents)""")  # fmt: skip
def noise(spark, sf_dir):
    """Of texts with a page number before or a line of a footer after them; a text that is null counts as empty."""
    noisy = docs(spark, sf_dir).fillna("", ["text"]).select("doc_id", F.expr(NOISY).alias("t"))
    return noisy.select("doc_id", sc.matched_percent(F.col("t")).alias("noise"))


@R.add("C23_record_scores")
def record_scores(spark, sf_dir):
    """Base scores with coherence, freedom from noise and freshness, and the trust in each document."""
    text, words = F.col("text"), F.col("words")
    parts = {
        "Accuracy": F.lit(85.0), "Secure": sc.secure(text), "Quality": sc.readability(text, words), "Completeness": sc.completeness(words), "Context_Quality": sc.context_quality(text, words), "KnowledgeBase_Ready": sc.knowledge_base_ready(text, words),
        "Avg_Chunk_Coherence": sc.coherence(tx.sentences(text), text, single=1.0), "Avg_Noise_Free_Score": F.round(100 - sc.noise_percent(text), 2), "Context_Freshness_Score": sc.freshness(F.col("doc_id") % 400, F.expr(DOMAIN)),
    }
    scored = docs(spark, sf_dir).withColumn("words", tx.word_count(text)).select("doc_id", *[c.alias(k) for k, c in parts.items()])
    return scored.select("*", sc.trust({k: F.col(k) for k in parts}, sc.WEIGHTS).alias("trust"))


@R.add("G02_aggregate_ready", rf"""
WITH c AS (SELECT source, CASE WHEN len({WORDS}) > 1000 THEN 100.0 ELSE 75.0 END AS completeness, CASE WHEN len({WORDS}) > 50 AND contains(text, chr(10)) THEN 100.0 ELSE 50.0 END AS kb,
  CASE WHEN regexp_matches(text, '{SSN}') OR regexp_matches(text, '{PHONE}') OR regexp_matches(text, '{EMAIL}') THEN 0.0 ELSE 100.0 END AS secure, 100.0 * pow(0.5, (doc_id % 400) / 365.0) AS fresh,
  CASE WHEN NOT regexp_matches(rtrim(text), '[.!?][\x22\x27)\]]*$') AND (NOT regexp_matches(rtrim(text), '\w$') OR length(rtrim(text)) < 20) THEN 1.0 ELSE 0.0 END AS cut FROM documents)
SELECT source, round(100 * (0.15 * 0.85 + 0.15 * avg(secure) / 100 + 0.08 * avg(completeness) / 100 + 0.10 + 0.05 * (1 - avg(cut)) + 0.05 * avg(fresh) / 100 + 0.05 * avg(kb) / 100), 2) AS trust FROM c GROUP BY source""")  # fmt: skip
def aggregate_ready(spark, sf_dir):
    """The trust in each source from the means of its documents; what is not measured here counts as if it were not there."""
    text, words = F.col("text"), F.size(tx.word_list(F.col("text")))
    means = {
        "Accuracy": F.lit(85.0), "Secure": F.avg(sc.secure(text)), "Completeness": F.avg(sc.completeness(words)), "KnowledgeBase_Ready": F.avg(sc.knowledge_base_ready(text)),
        "Chunk_Boundary_Quality": 100 * (1 - F.avg(tx.ends_mid_sentence(text).cast("double"))), "Context_Freshness_Score": F.avg(sc.freshness(F.col("doc_id") % 400, F.lit("general"))),
    }
    return docs(spark, sf_dir).groupBy("source").agg(F.round(sc.aggregate_trust(means), 2).alias("trust"))


@R.add("G08_readiness", f"""
WITH m AS (SELECT source, count(*) AS n, count_if(length(text) < 50) AS empty, count(*) - count(DISTINCT text) AS dup, count_if(len({WORDS}) < 10) AS low, avg(length(text)) AS mean, min(length(text)) AS lo, max(length(text)) AS hi FROM documents GROUP BY source),
s AS (SELECT source, 10 - least(3.0, 10 * empty / n) - least(2.0, 10 * dup / n) - least(1.5, 10 * low / n) AS data,
  10.0 - CASE WHEN mean < 200 THEN 2 WHEN mean > 1500 THEN 1.5 ELSE 0 END - CASE WHEN lo < 50 THEN 2.5 ELSE 0 END - CASE WHEN hi > 3000 THEN 2 ELSE 0 END AS chunk,
  10.0 - CASE WHEN n < 5 THEN 3 WHEN n < 20 THEN 1.5 ELSE 0 END - CASE WHEN n < 100 THEN 2.5 ELSE 0 END AS coverage FROM m)
SELECT source, round(data * 0.3 + chunk * 0.3 + 1.7 + coverage * 0.2, 1)::DOUBLE AS overall, round(data, 1)::DOUBLE AS data, round(chunk, 1)::DOUBLE AS chunk, 8.5::DOUBLE AS embedding, round(coverage, 1)::DOUBLE AS coverage FROM s""")  # fmt: skip
def ready(spark, sf_dir):
    text, n = F.col("text"), F.count(F.lit(1))
    size, few = F.length("text"), F.size(tx.word_list(F.col("text"))) < 10
    score = sc.readiness(n, F.count_if(size < 50), n - F.count_distinct("text"), F.count_if(text.contains("\0")), F.count_if(few), F.avg(size), F.min(size), F.max(size), n)
    return docs(spark, sf_dir).groupBy("source").agg(score.alias("s")).select("source", "s.*")


ADDED = [
    "the parties hereby agree to the terms of the contract", "the auditor checks compliance and risk governance", "bank liquidity and the balance sheet", "import os", "# A heading", "Ann: hello", "the abstract and the findings of a study", "query the database index",
]
TYPED = "concat(text, CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN repeat('\\n{x}. ', 3)" for i, x in enumerate(ADDED)) + " ELSE '' END)"
HINT, EXTENSION = "CASE doc_id % 5 WHEN 0 THEN 'Legal' WHEN 1 THEN 'technical' WHEN 2 THEN 'other' END", "CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.pdf' WHEN 2 THEN '.py' END"


def count_sql(pattern: str) -> str:
    """Matches of a pattern; where it tells words, of the text t2, which has every character between words twice."""
    if not pattern.startswith(r"\b"):
        return f"len(regexp_extract_all(t, '(?im){pattern}'))"
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b").replace(" ", "  ")
    return f"len(regexp_extract_all(t2, '(?im){EDGE}{inner}{END}'))"


def kind_sql(patterns: list[str]) -> str:
    return "(" + " + ".join(f"least(1.0::DOUBLE, {count_sql(p)} / (length(t) / 1000.0::DOUBLE))" for p in patterns) + f") / {len(patterns)}"


@R.add("X16_content_type", rf"""
WITH x AS (SELECT doc_id, text || CASE doc_id % 9 {" ".join(f"WHEN {i} THEN repeat(chr(10) || '{a}. ', 3)" for i, a in enumerate(ADDED))} ELSE '' END AS t, lower({HINT}) AS hint, {EXTENSION} AS ext FROM documents),
y AS (SELECT *, regexp_replace(t, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') AS t2 FROM x),
k AS ({" UNION ALL ".join(f"SELECT doc_id, hint, ext, {i} AS place, '{name}' AS kind, {kind_sql(patterns)} AS score FROM y" for i, (name, patterns) in enumerate(tx.CONTENT.items()))}
  UNION ALL SELECT doc_id, hint, ext, 8, 'general', 0 FROM y),
p AS (SELECT doc_id, hint, kind, CASE WHEN prior THEN -1 ELSE place END AS place, CASE WHEN prior AND score = 0 THEN CASE ext WHEN '.py' THEN 0.8 WHEN '.md' THEN 0.6 ELSE 0.5 END ELSE score END AS score
  FROM (SELECT *, coalesce((ext = '.py' AND kind = 'code') OR (ext = '.md' AND kind = 'documentation') OR (ext = '.pdf' AND kind = 'general'), false) AS prior FROM k)),
h AS (SELECT doc_id, kind, place, CASE WHEN hint = kind AND b < 0.5 THEN greatest(score, 0.6) WHEN hint = kind AND score > 0 THEN least(1.0, score + 0.2) ELSE score END AS score FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS b FROM p))
SELECT doc_id, CASE WHEN score > 0 THEN kind ELSE 'general' END AS kind, round(CASE WHEN score > 0 THEN score ELSE 0.3 END, 6)::DOUBLE AS confidence FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) = 1""")  # fmt: skip
def content_types(spark, sf_dir):
    """Of documents to which lines of several kinds are added, with hints and file names."""
    found = tx.content_type(F.expr(TYPED), F.expr(EXTENSION), F.expr(HINT))
    return docs(spark, sf_dir).select("doc_id", F.inline(F.array(found))).withColumn("confidence", F.round("confidence", 6))


@R.add("X17_chunk_sizes", rf"""
WITH m AS (SELECT doc_id, len({WORDS}) AS w, CASE WHEN len({SENTENCES}) > 0 THEN len({WORDS}) / len({SENTENCES}) ELSE 0 END AS mean FROM documents),
a AS (SELECT *, CASE WHEN mean > 30 THEN 1200 WHEN mean < 15 THEN 800 ELSE 1000 END AS size, CASE WHEN mean > 30 THEN 240 WHEN mean < 15 THEN 160 ELSE 200 END AS overlap FROM m),
b AS (SELECT doc_id, CASE WHEN w < 100 THEN least(size, w * 4) WHEN w > 10000 THEN size * 11 // 10 ELSE size END AS size, CASE WHEN w < 100 THEN least(overlap, least(size, w * 4) // 4) WHEN w > 10000 THEN overlap * 11 // 10 ELSE overlap END AS overlap FROM a)
SELECT doc_id, CAST(greatest(100, least(size, 1100)) AS INTEGER) AS size, CAST(least(overlap, greatest(100, least(size, 1100)) - 1) AS INTEGER) AS overlap FROM b""")  # fmt: skip
def chunk_sizes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.inline(F.array(tx.chunk_sizes(F.col("text"), 1000, 200, 100, 1100))))


TRIMMED = r"list_transform(string_split(text, '.'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g'))"
STYLES = {
    "technical": (20, 5, "CASE WHEN len(k) > 0 THEN 'What is ' || k[1] || '?' ELSE 'How does ' || w[1] || ' work?' END"),
    "academic": (30, 8, "CASE WHEN len(u) > 0 THEN 'What are the findings on ' || u[1] || '?' ELSE 'What does the research show about ' || w[4] || '?' END"),
    "clinical": (25, 6, "CASE WHEN len(m) > 0 THEN 'What is the ' || m[1] || '?' ELSE 'What are the clinical indications?' END"),
    "general": (20, 5, "'What is ' || w[1] || '?'"),
}


@R.add("X36_queries", " UNION ALL ".join(rf"""
SELECT doc_id, style, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS position, query FROM (SELECT doc_id, '{style}' AS style, i, {query} AS query FROM (
  SELECT *, list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}')) AS u, list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}') OR lower(x) IN ('api', 'sdk', 'cli', 'config')) AS k, list_filter(w, lambda x: lower(x) IN ('patient', 'diagnosis', 'treatment', 'medication', 'dose')) AS m FROM (
    SELECT doc_id, i, list_filter(string_split_regex(s, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, list_filter({TRIMMED}, lambda s: length(s) > {chars})[1:5] AS parts FROM documents)))) WHERE len(w) > {words}) WHERE length(query) BETWEEN 10 AND 50""" for style, (chars, words, query) in STYLES.items()))  # fmt: skip
def synthetic_queries(spark, sf_dir):
    """Five queries in each of four styles from every document."""
    each = F.array(*[F.struct(F.lit(style).alias("style"), tx.synthetic_queries(F.col("text"), style, 5).alias("queries")) for style in STYLES])
    rows = docs(spark, sf_dir).select("doc_id", F.explode(each).alias("s"))
    return rows.select("doc_id", "s.style", F.posexplode("s.queries").alias("position", "query"))


PIECES = "SELECT doc_id, source, concat(text, CASE WHEN doc_id % 5 = 0 THEN ' It is not so' ELSE '' END) AS text, concat('file', doc_id % 7) AS doc FROM documents"


@R.add("K07_conflicts", rf"""
WITH t AS (SELECT DISTINCT source, doc_id AS rank, doc, unnest(ws) AS term, len(list_intersect(ws, ['not', 'no', 'never', 'cannot', 'can''t', 'won''t', 'doesn''t', 'don''t', 'isn''t', 'aren''t'])) > 0 AS negated FROM (
  SELECT *, {WORDS.replace('text', 'lower(text)')} AS ws FROM ({PIECES}))),
w AS (SELECT * FROM t WHERE length(term) > 4 AND term NOT IN ('never', 'cannot', 'can''t', 'won''t', 'doesn''t', 'don''t', 'isn''t', 'aren''t')),
s AS (SELECT source, term, rank AS since, doc AS stated_in FROM w WHERE NOT negated QUALIFY row_number() OVER (PARTITION BY source, term ORDER BY rank) = 1),
c AS (SELECT source, rank, w.term, doc AS negated_in, stated_in FROM w JOIN s USING (source, term) WHERE negated AND since < rank AND stated_in <> doc QUALIFY row_number() OVER (PARTITION BY source, rank ORDER BY w.term) = 1)
SELECT source, rank, term, negated_in, stated_in FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank) <= 3""")  # fmt: skip
def conflict_hints(spark, sf_dir):
    """A source is a context; every fifth document says `not`."""
    pieces = docs(spark, sf_dir).select("source", F.col("doc_id").alias("rank"), F.expr("concat('file', doc_id % 7)").alias("doc"), F.expr("concat(text, CASE WHEN doc_id % 5 = 0 THEN ' It is not so' ELSE '' END)").alias("text"))
    return conflicts(pieces, "source")


#: Parts stand for rules, and the items shipped of a part for its violations.
CREATED = "CASE WHEN p_partkey % 3 = 0 THEN '1997' ELSE '1998' END || '-' || lpad('' || (1 + p_partkey % 12), 2, '0') || '-05'"
RULES = f"(SELECT p_partkey AS rule_id, {CREATED} AS created, CASE WHEN p_size > 20 THEN 'active' ELSE 'draft' END AS status, substr(p_brand, 1, 7) AS tag FROM part)"
BROKEN = "(SELECT l_partkey AS rule_id, strftime(l_shipdate, '%Y-%m-%d') AS created FROM lineitem WHERE l_quantity > 45)"


@R.add("G17_compliance_report", f"""
SELECT count(*) AS total_rules, count_if(status = 'active') AS active_rules, (SELECT count(*) FROM {BROKEN} WHERE created BETWEEN '1998-01-01' AND '1998-12-31' AND rule_id IN (SELECT rule_id FROM {RULES})) AS violations,
  round(100.0::DOUBLE * count_if(status = 'active') / count(*), 6) AS score FROM {RULES} WHERE tag = 'Brand#1' AND created BETWEEN '1998-01-01' AND '1998-12-31'""")  # fmt: skip
def compliance_report(spark, sf_dir):
    rules = table(spark, sf_dir, "part").selectExpr("p_partkey AS rule_id", f"{CREATED} AS created", "CASE WHEN p_size > 20 THEN 'active' ELSE 'draft' END AS status", "array(substr(p_brand, 1, 7)) AS tags")
    broken = table(spark, sf_dir, "lineitem").where("l_quantity > 45").selectExpr("l_partkey AS rule_id", "date_format(l_shipdate, 'yyyy-MM-dd') AS created")
    return compliance(rules, broken, "1998-01-01", "1998-12-31", "Brand#1").withColumn("score", F.round("score", 6))


@R.add("X24_chunk_records", rf"""
WITH p AS (SELECT doc_id, source, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents),
c AS (SELECT doc_id, source, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS i, len(parts) AS n FROM p)
SELECT source || '_' || doc_id || '_p1_sintroduction_c' || i AS chunk_id, CAST(i AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS chunk_of, greatest(length(text) // 4, len({WORDS})) AS token_est, md5(text) AS text FROM c""")  # fmt: skip
def chunk_records(spark, sf_dir):
    """The paragraphs of every document as records of its first page's introduction."""
    part = F.filter(F.transform(F.split("text", r"\n\s*\n"), tx.stripped), lambda p: p != "")
    rows = docs(spark, sf_dir).select(F.concat_ws("_", "source", "doc_id").alias("stem"), F.posexplode(part).alias("i", "text"), F.size(part).alias("n"))
    record = tx.chunk_record(F.col("stem"), F.lit(1), F.lit("Introduction"), F.col("text"), F.col("i"), F.col("n"))
    return rows.select(record.alias("r")).select("r.chunk_id", "r.chunk_index", "r.chunk_of", "r.token_est", F.md5("r.text").alias("text"))


QUERIES, ORACLE = R.queries, R.oracle
