"""Joins, filters, aggregates, search and lineage over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.operators import vector_index as vi
from loomwright.operators.selection import exact_percentiles
from loomwright.sources.folders import shared_folder
from loomwright.functions import scores as sc
from loomwright.functions import text as tx
from loomwright.operators import lineage as ln
from loomwright.operators import retrieval as rt
from loomwright.plans.registry import Registry, table

R = Registry()


def ev(spark, sf_dir):
    return table(spark, sf_dir, "events")


@R.add("J01_inner_join", "SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def inner_join(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add("J02_left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_join(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@R.add("J03_self_join", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@R.add("J04_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@R.add("J05_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@R.add("J06_lookup_cascade", """SELECT d.doc_id, coalesce(l.quality * 100, s.best, 0) AS score FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)
LEFT JOIN (SELECT source, max(quality) * 10 AS best FROM labels JOIN documents USING (doc_id) GROUP BY source) s USING (source)""")  # fmt: skip
def lookup_cascade(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = l.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    by_source = l.join(d, "doc_id").groupBy("source").agg((F.max("quality") * 10).alias("best"))
    return d.join(own, "doc_id", "left").join(by_source, "source", "left").select("doc_id", F.coalesce(F.col("quality") * 100, F.col("best"), F.lit(0)).alias("score"))


@R.add("J07_case_insensitive_join", "SELECT event_id, declared FROM events JOIN (SELECT DISTINCT upper(event_type) AS declared FROM events) ON lower(event_type) = lower(declared)")
def case_insensitive(spark, sf_dir):
    e = ev(spark, sf_dir)
    declared = e.select(F.upper("event_type").alias("declared")).distinct()
    return e.join(declared, F.lower("event_type") == F.lower("declared")).select("event_id", "declared")


@R.add("J08_acl_filter", """SELECT doc_id AS chunk_id FROM documents WHERE source IN ('src1', 'src2') OR doc_id = 7 OR contains(lower(lang), 'fr') OR contains('fr', lower(lang))""")
def acl_filter(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("product"), F.col("doc_id").cast("string").alias("document"), F.col("lang").alias("field"))
    acl = spark.createDataFrame([("index", "src1"), ("index", "src2"), ("document", "7"), ("field", "FR")], "access string, value string")
    return rt.allowed(chunks, acl).select("chunk_id")


@R.add("J09_version_diff", """WITH v1 AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0), v2 AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 1)
SELECT doc_id, CASE WHEN v1.text IS NULL THEN 'added' WHEN v2.text IS NULL THEN 'removed' WHEN v1.text = v2.text THEN 'same' ELSE 'changed' END AS change, coalesce(length(v2.text), 0) - coalesce(length(v1.text), 0) AS delta FROM v1 FULL JOIN v2 USING (doc_id)""")  # fmt: skip
def version_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    a = d.where("doc_id % 3 <> 0").withColumnRenamed("text", "old")
    b = d.where("doc_id % 3 <> 1").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, "doc_id", "full").select("doc_id", change.alias("change"), (F.coalesce(F.length("new"), F.lit(0)) - F.coalesce(F.length("old"), F.lit(0))).alias("delta"))


@R.add("J10_run_diff", "SELECT event_type, CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' ELSE 'second' END AS found FROM (SELECT event_type, bool_or(user_id % 2 = 0) AS a, bool_or(user_id % 2 = 1) AS b FROM events GROUP BY event_type)")
def run_diff(spark, sf_dir):
    a = ev(spark, sf_dir).where("user_id % 2 = 0").select("event_type", F.lit(True).alias("a")).distinct()
    b = ev(spark, sf_dir).where("user_id % 2 = 1").select("event_type", F.lit(True).alias("b")).distinct()
    return a.join(b, "event_type", "full").select("event_type", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("found"))


@R.add("J11_map_diff", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'status' ELSE '' END AS added, CASE WHEN o_orderkey % 3 = 0 THEN 'price' ELSE '' END AS removed FROM orders")
def map_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    entry = lambda k: F.create_map(F.lit(k), F.lit(1))
    none = F.create_map().cast("map<string,int>")
    before = F.map_concat(entry("key"), F.when(F.col("o_orderkey") % 3 == 0, entry("price")).otherwise(none))
    after = F.map_concat(entry("key"), F.when(F.col("o_orderkey") % 2 == 0, entry("status")).otherwise(none))
    keys = lambda a, b: F.array_join(F.array_except(F.map_keys(a), F.map_keys(b)), ",")
    return o.select("o_orderkey", keys(after, before).alias("added"), keys(before, after).alias("removed"))


@R.add("F01_range_filters", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount <= 0.02 AND l_returnflag = 'R'")
def range_filters(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 20) & (F.col("l_discount") <= 0.02) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber")


@R.add("F02_term_filter", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source = 'src3'")
def term_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr") & (F.col("source") == "src3")).select("doc_id")


@R.add("F03_pagination", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def pagination(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@R.add("F04_audit_filter", "SELECT event_id, ts FROM events WHERE event_type = 'click' AND ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) ORDER BY ts DESC, event_id LIMIT 100")
def audit_filter(spark, sf_dir):
    e = ev(spark, sf_dir)
    last = e.agg(F.max("ts").alias("last"))
    recent = e.join(F.broadcast(last)).where((F.col("event_type") == "click") & (F.col("ts") >= F.expr("last - INTERVAL 7 DAYS")))
    return recent.select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(100)


@R.add("F05_contains_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot')")
def contains_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.lower("text").contains("idiot")).select("doc_id")


@R.add("F06_chunk_lookup", "SELECT doc_id, lang, source FROM documents WHERE source = 'src5' AND lang = 'en' ORDER BY doc_id LIMIT 25 OFFSET 5")
def chunk_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source = 'src5' AND lang = 'en'").select("doc_id", "lang", "source").orderBy("doc_id").offset(5).limit(25)


@R.add("C25_text_jaccard", r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w FROM documents)
SELECT a.doc_id, round(CASE WHEN len(list_distinct(a.w || b.w)) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) ELSE 0 END, 6) AS score FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")  # fmt: skip
def text_jaccard(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", tx.word_list(F.col("text")).alias("w"))
    return w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")), "doc_id").select("doc_id", F.round(tx.jaccard(F.col("w"), F.col("v")), 6).alias("score"))


def neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


PAIRS = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@R.add("C26_cosine", f"SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score {PAIRS}")
def cosine(spark, sf_dir):
    return neighbours(spark, sf_dir).select("vec_id", F.round(sc.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@R.add("C27_euclidean", f"SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score {PAIRS}")
def euclidean(spark, sf_dir):
    return neighbours(spark, sf_dir).select("vec_id", F.round(sc.euclidean(F.col("embedding"), F.col("other")), 6).alias("score"))


RANKED = """ranked AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) DESC, p.vec_id) AS rank FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0)"""


def searched(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return rt.nearest(queries, e.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("v")), 10, -1.0)


@R.add("K02_knn", f"WITH {RANKED} SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def knn(spark, sf_dir):
    return searched(spark, sf_dir).withColumn("score", F.round("score", 6))


def indexed(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("v"), "label")
    return vi.build_index(points, shared_folder(spark)), table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@R.add("K01_ann_search")
def ann_search(spark, sf_dir):
    """The ten nearest by a stored index, half of whose lists each query probes; recall is measured in the tests."""
    index, queries = indexed(spark, sf_dir)
    return vi.search(index, queries, 10, -(-len(index.centroids) // 2))


@R.add("K01_all_lists", f"WITH {RANKED} SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def all_lists(spark, sf_dir):
    """With all lists probed the index answers exactly."""
    index, queries = indexed(spark, sf_dir)
    return vi.search(index, queries, 10, len(index.centroids)).withColumn("score", F.round("score", 6))


@R.add("K01_filtered", f"WITH {RANKED.replace('WHERE q.vec_id % 100 = 0', 'WHERE q.vec_id % 100 = 0 AND p.label < 5')} SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, round(score, 6) AS score FROM ranked WHERE rank <= 5 AND score >= 0.2")
def filtered_search(spark, sf_dir):
    """A filter on the points' labels inside the scan of the lists, and a threshold."""
    index, queries = indexed(spark, sf_dir)
    return vi.search(index, queries, 5, len(index.centroids), "label < 5", 0.2).withColumn("score", F.round("score", 6))


@R.add("S18_scroll_page", "SELECT vec_id AS point_id, label FROM embeddings WHERE vec_id > (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 1 OFFSET 99) ORDER BY vec_id LIMIT 100")
def scroll_page(spark, sf_dir):
    """The second page of a hundred: the first one's last id is its cursor."""
    index, _ = indexed(spark, sf_dir)
    first = vi.scrolled(index, spark, None, 100).agg(F.max("point_id").alias("last")).first()["last"]
    return vi.scrolled(index, spark, first, 100).select("point_id", "label")


@R.add("K10_self_retrieval", f"WITH {RANKED}, h AS (SELECT rank FROM ranked WHERE query_id = point_id) SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(1.0 / rank), 6) AS mrr, round(avg(1.0 / log2(1 + rank)), 6) AS ndcg FROM h")
def self_retrieval(spark, sf_dir):
    expected = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("point_id"))
    found = rt.retrieval_metrics(searched(spark, sf_dir), expected)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@R.add("K09_vector_quality", """WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings), m AS (SELECT median(n) AS med FROM n), d AS (SELECT n, abs(n - med) AS dev FROM n, m), mad AS (SELECT median(dev) AS mad FROM d)
SELECT count(*) AS vectors, count_if(n > 0) AS nonzero, count_if(0.6745 * dev / mad > 3.5) AS outliers, round(stddev_pop(n) / avg(n), 6) AS variation FROM d, mad""")  # fmt: skip
def vector_quality(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = table(spark, sf_dir, "embeddings").select(norm.alias("n"))
    median = lambda rows, name, as_: exact_percentiles(rows, [], name, [0.5]).select(F.col(name).alias(as_))
    d = n.join(F.broadcast(median(n, "n", "med"))).withColumn("dev", F.abs(F.col("n") - F.col("med")))
    out = d.join(F.broadcast(median(d, "dev", "mad")))
    return out.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("n") > 0).alias("nonzero"), F.count_if(0.6745 * F.col("dev") / F.col("mad") > 3.5).alias("outliers"), F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("variation"))


@R.add("K05_context_order", "SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY best DESC, source) AS INTEGER) AS place FROM (SELECT doc_id, source, max(n_chars) OVER (PARTITION BY source) AS best FROM documents)")
def context_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    best = d.groupBy("source").agg(F.max("n_chars").alias("best"))
    placed = best.select("source", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("best"), "source")).alias("place"))
    return d.join(placed, "source").select("doc_id", "source", "place")


@R.add("K06_budget_cut", "SELECT doc_id, source, used FROM (SELECT doc_id, source, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) WHERE used <= 8000")
def budget_cut(spark, sf_dir):
    return rt.within_budget(table(spark, sf_dir, "documents"), "source", ["doc_id"], F.col("n_chars"), 8000).select("doc_id", "source", "used")


@R.add("G09_workspace_metrics", "SELECT event_type, count(*) AS n, count_if(value > 50) AS good, round(100.0 * count_if(value > 50) / count(*), 4) AS success_pct, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type")
def workspace_metrics(spark, sf_dir):
    good = F.count_if(F.col("value") > 50)
    return ev(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), good.alias("good"), F.round(100.0 * good / F.count(F.lit(1)), 4).alias("success_pct"), F.round(F.avg("value"), 4).alias("mean_value"))


@R.add("G10_monthly_stats", """WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, date_trunc('month', max(o_orderdate)) AS hi FROM orders), m AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM b)
SELECT month, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM m LEFT JOIN orders ON CAST(date_trunc('month', o_orderdate) AS DATE) = month GROUP BY month""")  # fmt: skip
def monthly_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("month", F.trunc("o_orderdate", "MM"))
    by_month = o.groupBy("month").agg(F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    months = by_month.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    return months.join(by_month, "month", "left").select("month", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@R.add("G11_audit_statistics", "SELECT event_type, CAST(user_id % 5 AS VARCHAR) AS resource, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (CAST(user_id % 5 AS VARCHAR)), ())")
def audit_statistics(spark, sf_dir):
    e = ev(spark, sf_dir).select("event_type", (F.col("user_id") % 5).cast("string").alias("resource"))
    return e.groupingSets([["event_type"], ["resource"], []], "event_type", "resource").agg(F.count(F.lit(1)).alias("n"))


@R.add("G12_cost_analytics", "SELECT l_shipmode, round(bytes / 1e9 * 0.023, 8) AS cost, n FROM (SELECT l_returnflag AS l_shipmode, sum(l_extendedprice) AS bytes, count(*) AS n FROM lineitem GROUP BY 1)")
def cost_analytics(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.sum("l_extendedprice").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return by.select("l_shipmode", F.round(F.col("bytes") / 1e9 * 0.023, 8).alias("cost"), "n")


@R.add("G13_cleanup_duplicates", "SELECT l_suppkey, l_linenumber, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def cleanup_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_quantity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@R.add("G14_run_summary", "SELECT l_linestatus, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY ALL")
def run_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@R.add("G16_next_version", "SELECT o_custkey, max(o_orderkey) + 1 AS next_version FROM orders GROUP BY o_custkey")
def next_version(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.max("o_orderkey") + 1).alias("next_version"))


@R.add("G21_audit_by_action", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def audit_by_action(spark, sf_dir):
    return ev(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@R.add("G23_alert_statistics", "SELECT CAST(user_id % 10 AS INTEGER) AS bucket, count_if(event_type = 'click') AS clicks, count_if(event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def alert_statistics(spark, sf_dir):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return ev(spark, sf_dir).groupBy((F.col("user_id") % 10).cast("int").alias("bucket")).agg(kind("click").alias("clicks"), kind("purchase").alias("purchases"))


@R.add("G24_pipeline_statistics", "SELECT event_type, round(avg(gap), 3) AS avg_gap, round(min(gap), 3) AS min_gap, round(max(gap), 3) AS max_gap FROM (SELECT event_type, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY event_type")
def pipeline_statistics(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    before = F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gaps = ev(spark, sf_dir).select("event_type", (F.unix_micros(at) / 1e6 - F.unix_micros(before) / 1e6).alias("gap")).where("gap is not null")
    return gaps.groupBy("event_type").agg(*[F.round(f("gap"), 3).alias(n) for n, f in (("avg_gap", F.avg), ("min_gap", F.min), ("max_gap", F.max))])


@R.add("G26_backfill_anti_join", "SELECT DISTINCT l_suppkey AS node FROM lineitem WHERE l_quantity > 49 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)")
def backfill(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    return table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("node")).distinct().join(known, "node", "left_anti")


@R.add("G27_duplicate_edges", "SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS \"count\" FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_edges(spark, sf_dir):
    return ln.duplicate_edges(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), ["src", "dst"])


@R.add("G28_status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@R.add("G30_vote", "SELECT source, lang, votes, round(votes / total, 6) AS confidence FROM (SELECT source, lang, count(*) AS votes, sum(count(*)) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS n FROM documents GROUP BY source, lang) WHERE n = 1")
def vote(spark, sf_dir):
    votes = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy("source")
    placed = votes.withColumns({"total": F.sum("votes").over(best), "n": F.row_number().over(best.orderBy(F.desc("votes"), "lang"))})
    return placed.where("n = 1").select("source", "lang", "votes", F.round(F.col("votes") / F.col("total"), 6).alias("confidence"))


EDGES = "SELECT DISTINCT l_suppkey AS src, l_suppkey + l_linenumber * 7 AS dst FROM lineitem"


@R.add("L03_lineage_reach", f"""WITH RECURSIVE e AS ({EDGES}), r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 10)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")  # fmt: skip
def lineage_reach(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + F.col("l_linenumber") * 7).alias("dst")).distinct()
    return ln.reach(edges, spark.createDataFrame([(1,)], "node long"))


@R.add("L02_upstream", f"SELECT DISTINCT src AS node FROM ({EDGES}) WHERE dst = 30")
def upstream(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), (F.col("l_suppkey") + F.col("l_linenumber") * 7).alias("dst")).where("dst = 30").select("node").distinct()


@R.add("L06_impact", f"SELECT src AS node, count(DISTINCT dst) AS affected, CASE WHEN count(DISTINCT dst) > 10 THEN 'high' WHEN count(DISTINCT dst) > 5 THEN 'medium' ELSE 'low' END AS level FROM ({EDGES}) GROUP BY src")
def impact(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), (F.col("l_suppkey") + F.col("l_linenumber") * 7).alias("dst"))
    out = edges.groupBy("node").agg(F.count_distinct("dst").alias("affected"))
    return out.withColumn("level", F.when(F.col("affected") > 10, "high").when(F.col("affected") > 5, "medium").otherwise("low"))


QUERIES, ORACLE = R.queries, R.oracle
