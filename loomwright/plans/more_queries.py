"""Further operators of the inventory over the supplied tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.operators.coherence import coherence_by_embeddings
from loomwright.operators.selection import exact_percentiles
from loomwright.functions import scores as sc
from loomwright.functions import text as tx
from loomwright.operators import lineage as ln
from loomwright.plans.registry import Registry, table
from loomwright.sources.files import point_id

R = Registry()
WORDS = r"list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@R.add("C07_context_quality", rf"""
SELECT doc_id, CASE WHEN length(trim(text)) < 50 THEN 30.0 ELSE least(100.0, 40.0 + CASE WHEN contains(text, chr(10) || chr(10)) OR length(text) - length(replace(text, chr(10), '')) > 3 THEN 20 ELSE 0 END
 + CASE WHEN regexp_matches(text, '(?m)(?:^|\n)\s*[•\-*+]\s') OR regexp_matches(text, '(?m)(?:^|\n)\s*\d+[.)]\s') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(text, '(?:^|[^\p{{L}}\p{{N}}_])\d+(?:[.,]\d+)?(?:USD|EUR|million|billion)?(?:[^\p{{L}}\p{{N}}_]|$)') THEN 15 ELSE 0 END
 + CASE WHEN regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}_])(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}})(?:[^\p{{L}}\p{{N}}_]|$)') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '\b(?:see|refer|reference|section|chapter|page|table|figure)\s+\d+') THEN 10 ELSE 0 END
 + least(15.0, 2.0 * ({' + '.join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in sc.INDICATORS)})) + CASE WHEN regexp_matches(text, '(?:^|[^\p{{L}}\p{{N}}_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?:[^\p{{L}}\p{{N}}_]|$)') THEN 10 ELSE 0 END
 + CASE WHEN len({WORDS}) > 100 THEN least((len({WORDS}) - 100) / 20.0, 10.0) ELSE 0 END) END AS score FROM documents""")  # fmt: skip
def context_quality(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", sc.context_quality(F.col("text")).alias("score"))


@R.add("C21_embedding_coherence")
def embedding_coherence(spark, sf_dir):
    """By the hash encoder; every third document counts leniently. The tests hold a plain version against it."""
    limit = F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(0.6)
    return docs(spark, sf_dir).select("doc_id", coherence_by_embeddings(tx.sentences(F.col("text")), limit).alias("c")).select("doc_id", "c.*")


@R.add("C22_coherence")
def coherence(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(sc.coherence(tx.sentences(F.col("text")), F.col("text")), 4).alias("score"))


@R.add("C28_hash_embedding", "SELECT doc_id, round(least(length(text) / 1000.0, 1.0), 6)::DOUBLE AS v0, " + ", ".join(f"round((('0x' || substr(sha256(text), {2 * (i % 32) + 1}, 2))::INTEGER - 128) / 128.0, 6)::DOUBLE AS v{i}" for i in range(1, 40)) + " FROM documents")
def hash_embedding(spark, sf_dir):
    """All of forty dimensions: the bytes of a digest begin again after 32."""
    vector = docs(spark, sf_dir).select("doc_id", sc.hash_embedding(F.col("text"), 40).alias("v"))
    return vector.select("doc_id", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(40)])


@R.add("C29_dimension_fit", "SELECT vec_id, 100 AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def dimension_fit(spark, sf_dir):
    fitted = sc.fitted(F.col("embedding").cast("array<double>"), 100)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(fitted).alias("n"), F.round(F.aggregate(fitted, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@R.add("X15_sentences")
def sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(tx.sentences(F.col("text"))).alias("sentences"))


@R.add("X31_keywords", rf"""
WITH w AS (SELECT doc_id, regexp_replace(unnest(ws), '^[.,;:!?\x22\x27()\[\]{{}}]+|[.,;:!?\x22\x27()\[\]{{}}]+$', '', 'g') AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {WORDS.replace('text', 'lower(text)')} AS ws FROM documents)),
u AS (SELECT doc_id, w, min(i) AS i FROM w WHERE length(w) > 4 AND w NOT IN ({", ".join(f"'{w}'" for w in tx.STOP_WORDS)}) GROUP BY ALL),
k AS (SELECT doc_id, w, i FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, i) <= 5)
SELECT doc_id, coalesce((SELECT string_agg(w, ',' ORDER BY length(w) DESC, i) FROM k WHERE k.doc_id = d.doc_id), '') AS keywords FROM documents d""")  # fmt: skip
def keywords(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(tx.keywords(F.col("text")), ",").alias("keywords"))


@R.add("X33_cleaned", r"SELECT doc_id, md5(substr(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\s+', ' ', 'g'), '^ +| +$', '', 'g'), 1, 500)) AS clean FROM documents")
def cleaned(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.cleaned(F.col("text"), 500)).alias("clean"))


@R.add("X01_unwrapped")
def unwrapped(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.unwrapped(F.col("text"))).alias("text"))


@R.add("X18_preview", "SELECT count(*) AS chunks, round(avg(n), 4) AS mean, min(n) AS least, max(n) AS most, round(var_pop(n), 2) AS variance FROM (SELECT least(800, length(text) - s) AS n FROM (SELECT text, unnest(range(0, greatest(length(text), 1), 720)) AS s FROM documents WHERE length(text) > 0))")
def preview(spark, sf_dir):
    n = docs(spark, sf_dir).select(F.explode(tx.char_chunks(F.col("text"), 200, 20)).alias("c")).select(F.length("c").alias("n"))
    return n.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("n"), 4).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.var_pop("n"), 2).alias("variance"))


@R.add("S15_checksums", "SELECT doc_id, sha256(text) AS checksum, strlen(text) AS bytes FROM documents")
def checksums(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("checksum"), F.octet_length("text").alias("bytes"))


@R.add("S17_point_ids", "SELECT doc_id, ('0x' || substr(md5(source || '_' || doc_id), 1, 15))::BIGINT AS point_id FROM documents")
def point_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", point_id(F.concat_ws("_", "source", "doc_id")).alias("point_id"))


@R.add("G05_trust_report", "SELECT CASE WHEN value >= 75 THEN 'high' ELSE 'low' END AS band, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def trust_report(spark, sf_dir):
    band = F.when(F.col("value") >= 75, "high").otherwise("low").alias("band")
    return table(spark, sf_dir, "events").groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@R.add("G06_quality_summary", "SELECT round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, list_extract(list_sort(list(value)), CAST(count(*) // 2 + 1 AS BIGINT)) AS upper_median, count_if(value >= 80) AS high, count_if(value >= 60 AND value < 80) AS good, count_if(value >= 40 AND value < 60) AS fair, count_if(value < 40) AS poor FROM events")
def quality_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    upper = exact_percentiles(e, [], "value", [0.5], upper=True).select(F.col("value").alias("upper_median"))
    band = lambda lo, hi: F.count_if((F.col("value") >= lo) & (F.col("value") < hi))
    out = e.agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_if(F.col("value") >= 80).alias("high"), band(60, 80).alias("good"), band(40, 60).alias("fair"), F.count_if(F.col("value") < 40).alias("poor"))
    return out.join(F.broadcast(upper))


@R.add("G19_improvement", "SELECT o_orderpriority, round(least(500, greatest(-100, (avg(o_totalprice) - 100000) / 100000 * 100)), 4) AS pct FROM orders GROUP BY o_orderpriority")
def improvement(spark, sf_dir):
    pct = F.least(F.lit(500.0), F.greatest(F.lit(-100.0), (F.avg("o_totalprice") - 100000) / 100000 * 100))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(pct, 4).alias("pct"))


@R.add("G22_gate_summary", "SELECT c_nationkey, c_mktsegment, count(o_orderkey) AS checks, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def gate_summary(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_nationkey", "c_mktsegment").agg(F.count("o_orderkey").alias("checks"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("passed"))


@R.add("G20_metrics_index", "SELECT source, max(n_chars) AS best, arg_max(doc_id, doc_id) AS last FROM documents GROUP BY source")
def metrics_index(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.max("n_chars").alias("best"), F.max_by("doc_id", "doc_id").alias("last"))


@R.add("G29_preprocessing_metrics", "SELECT source, lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def preprocessing_metrics(spark, sf_dir):
    return docs(spark, sf_dir).rollup("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@R.add("G31_version_statistics", "SELECT count(*) AS versions, count_if(o_orderstatus = 'F') AS active, count_if(o_orderstatus <> 'F') AS archived, max(o_orderkey) AS latest FROM orders")
def version_statistics(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("o_orderstatus") == "F").alias("active"), F.count_if(F.col("o_orderstatus") != "F").alias("archived"), F.max("o_orderkey").alias("latest"))


@R.add("G15_usage_limits", "SELECT c_nationkey, count(*) AS used, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS billable, count(*) > 60 AS over_limit FROM customer GROUP BY c_nationkey")
def usage_limits(spark, sf_dir):
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(n.alias("used"), F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0)).alias("billable"), (n > 60).alias("over_limit"))


@R.add("K04_context_dedup")
def context_dedup(spark, sf_dir):
    """Sequential: a text stays unless it is nearly one that stayed before it, within the few texts of a request."""

    def kept(frame: pd.DataFrame) -> pd.DataFrame:
        stayed: list[set] = []
        rows = []
        for doc_id, text in frame.sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False):
            words = set((text or "").lower().split())
            if all(len(words & s) < 0.95 * len(words | s) for s in stayed):
                stayed.append(words)
                rows.append(doc_id)
        return pd.DataFrame({"request": frame["request"].iloc[0], "doc_id": rows})

    requests = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 20).alias("request"), "doc_id", "text")
    return requests.groupBy("request").applyInPandas(kept, "request long, doc_id long")


@R.add("K08_context_assembly", "SELECT doc_id // 20 AS request, md5(string_agg('## ' || doc_id || chr(10) || text, chr(10) ORDER BY doc_id)) AS context FROM documents GROUP BY 1")
def context_assembly(spark, sf_dir):
    part = F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("part")
    rows = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 20).alias("request"), "doc_id", part)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "part"))), lambda s: s["part"])
    return rows.groupBy("request").agg(F.md5(F.array_join(parts, "\n")).alias("context"))


@R.add("K11_stratified_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE n <= 2")
def stratified_sample(spark, sf_dir):
    order = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    return docs(spark, sf_dir).withColumn("n", order).where("n <= 2").select("source", "doc_id")


EDGES = "(SELECT DISTINCT l_suppkey AS src, l_suppkey + l_linenumber * 7 AS dst, l_returnflag AS kind FROM lineitem)"


def edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + F.col("l_linenumber") * 7).alias("dst"), F.col("l_returnflag").alias("kind")).distinct()


@R.add("L04_graph_summary", f"SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM {EDGES} GROUP BY kind")
def graph_summary(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@R.add("L01_dangling_edges", f"SELECT DISTINCT src, dst FROM {EDGES} WHERE dst NOT IN (SELECT s_suppkey FROM supplier) OR src NOT IN (SELECT s_suppkey FROM supplier)")
def dangling_edges(spark, sf_dir):
    vertices = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return ln.orphans(edges(spark, sf_dir).select("src", "dst").distinct(), vertices)


@R.add("L05_artifact_lineage", f"WITH RECURSIVE e AS {EDGES}, r(node, depth) AS (SELECT 40::BIGINT, 0 UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 5) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node")
def artifact_lineage(spark, sf_dir):
    back = edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return ln.reach(back, spark.createDataFrame([(40,)], "node long"), 5)


@R.add("L07_stage_order", "SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events")
def stage_order(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_event")).where("next_event is not null")


R.oracle["L07_stage_order"] = f"SELECT * FROM ({R.oracle['L07_stage_order']}) WHERE next_event IS NOT NULL"


@R.add("V16_version_bump", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1.' || (o_orderkey % 10 + 1) || '.0' ELSE '1.' || (o_orderkey % 10) || '.1' END AS version FROM orders")
def version_bump(spark, sf_dir):
    minor = F.col("o_orderkey") % 10
    bumped = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("1."), (minor + 1).cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("1."), minor.cast("string"), F.lit(".1")))
    return table(spark, sf_dir, "orders").select("o_orderkey", bumped.alias("version"))


@R.add("V23_trust_check", "SELECT event_id, 'HIGH' AS severity FROM events WHERE value < 25")
def trust_check(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value < 25").select("event_id", F.lit("HIGH").alias("severity"))


QUERIES, ORACLE = R.queries, R.oracle
