"""The Bloom cascade against the longest match by brute force."""

import random

from loomwright.llm import url_cascade
from pyspark.sql import functions as F

UPPER = dict(zip(map(ord, url_cascade.UPPER), url_cascade.LOWER))


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate(UPPER), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], "allow" if best is None or not best[2] else "block"


def urls():
    rng = random.Random(3)
    hosts = ["example.net", "a.example.net", "Example.COM", "notexample.net", "net", "x.org", "org", "ÉX.org", "sub.a.b.net", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/y", "/fr/", "/fr/a/b"]
    made = [f"https://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f', '?a#b'])}" for _ in range(600)]
    return [None, "", "no scheme", "http://", "://", "http://net", "a://b://net/", "http://NET/?x", "http://net/" + "long/" * 20_000] + made


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(spark, rules, pages=None):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls())], "page_id long, url string") if pages is None else pages
    return url_cascade.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))


def test_longest_match(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(spark, RULES).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls())}


def test_ties_nulls_and_upper_case_rules(spark):
    rules = [*RULES, ("NET", "/", "allow"), (None, "/", "block"), ("org", None, "block"), ("org", "/fr/", "allow"), ("Éx.org", "/", "block")]
    known = [(h.translate(UPPER), p, v) for h, p, v in rules if h and p]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(spark, rules).collect()}
    assert got == {i: brute(u, known) for i, u in enumerate(urls())}


def test_no_rules_empty_table_and_clashing_names(spark):
    assert {(r.rule, r.verdict) for r in judged(spark, []).collect()} == {(None, "allow")}
    pages = spark.createDataFrame([(1, "http://a.net/x", "h", 3.0, "kept", "n")] * 2, "page_id long, url string, host string, rule double, other string, key string")
    rows = judged(spark, RULES, pages).collect()
    assert len(rows) == 2 and {(r.host, r.rule, r.verdict, r.other, r.key) for r in rows} == {("a.net", "net/", "block", "kept", "n")}
    assert judged(spark, RULES, pages.where("false")).collect() == []


def test_many_keys_in_several_cascades(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "MAX_BYTES", 32_000)
    listed = spark.range(100_000).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(50_000, 300_000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_cascade.build_cascade(listed, universe)
    assert len(cascade.parts) > 1 and all(len(level.words) * 8 <= 64_000 for levels in cascade.parts for level in levels)
    wrong = universe.withColumn("held", cascade.holds(F.col("key"))).where(F.col("held") != (F.substring("key", 2, 10).cast("long") < 100_000))
    assert wrong.count() == 0
