"""Profiles, rules and scores of the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import measures as ms
from loomwright.operators import phik as pk
from loomwright.operators import profile as pf
from loomwright.operators import rules as rl
from loomwright.plans.registry import Registry, table

REF = "2030-01-01 00:00:00"
COLUMNS = {
    "customer": {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "string"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "string"},
    "part": {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "float"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime"},
    "events": {"event_id": "int", "ts": "datetime", "user_id": "int", "event_type": "string", "value": "float", "props": "string"},
    "labelled": {"doc_id": "int", "label": "int", "review_result": "int"},
}
VIEWS = {"labelled": "(SELECT doc_id, quality AS label, toxic AS review_result FROM labels)"}
R = Registry()


def profiled(spark: SparkSession, sf_dir: str, name: str, only: set[str] | None = None) -> DataFrame:
    return pf.column_profile(source_of(spark, sf_dir, name), F.lit(REF).cast("timestamp"), only=only).withColumn("table_name", F.lit(name))


def profile_sql(name: str) -> str:
    """The same profile, a SELECT for each column."""
    parts = []
    tokens = ", ".join(f"'{t}'" for t in pf.SURROGATE_TOKENS)
    for k, (c, kind) in enumerate(COLUMNS[name].items()):
        number, dated = kind in ("int", "float"), kind == "datetime"
        of = lambda e, on, null="DOUBLE": e if on else f"CAST(NULL AS {null})"  # noqa: B023, E731
        surrogate = f"CAST(count_if({c} IN (-1, -999, 999, 9999)) AS BIGINT)" if number else f"CAST(count_if(lower(trim({c})) IN ({tokens})) AS BIGINT)" if kind == "string" else "0"
        parts.append(
            f"SELECT {k} AS ordinal, '{c}' AS column_name, '{kind}' AS dtype, count(*) AS row_count, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, "
            f"count(DISTINCT {c}) AS unique_count, {of(f'avg({c})', number)} AS mean, {of(f'stddev_samp({c})', number)} AS std, {of(f'CAST(min({c}) AS DOUBLE)', number)} AS min_value, {of(f'CAST(max({c}) AS DOUBLE)', number)} AS max_value, "
            + "".join(f"{of(f'quantile_cont(CAST({c} AS DOUBLE), {q})', number)} AS {n}, " for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
            + f"{of(f'skewness({c})', number)} AS skew, {of(f'kurtosis({c})', number)} AS kurtosis, {of(f'CAST(min({c}) AS TIMESTAMP)', dated, 'TIMESTAMP')} AS earliest, {of(f'CAST(max({c}) AS TIMESTAMP)', dated, 'TIMESTAMP')} AS latest, "
            + of(f"CAST(greatest(0, floor((epoch(TIMESTAMP '{REF}') - epoch(max({c}))) / 86400)) AS BIGINT)", dated, "BIGINT")
            + f" AS days_since_latest, {surrogate} AS surrogate_null_count, 0 AS infinite_count, '{name}' AS table_name FROM {VIEWS.get(name, name)}"
        )
    return " UNION ALL ".join(parts)


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in columns)


SHOWN = {
    "P01_dtypes": ["column_name", "dtype"],
    "P06_nulls": ["column_name", "row_count", "null_count", "null_pct"],
    "P07_distinct": ["column_name", "unique_count"],
    "P10_moments": ["column_name", *(f"round({c}, 4) AS {c}" for c in ("mean", "std", "min_value", "max_value"))],
    "P11_quartiles": ["column_name", *(f"round({c}, 4) AS {c}" for c in ("q25", "q50", "q75"))],
    "P12_shape": ["column_name", *(f"round({c}, 4) AS {c}" for c in ("skew", "kurtosis"))],
    "P13_surrogates": ["column_name", "surrogate_null_count"],
    "P14_ranges": ["column_name", "earliest", "latest"],
    "P15_freshness": ["column_name", "days_since_latest"],
    "P18_infinites": ["column_name", "infinite_count"],
}
for _name, _columns in SHOWN.items():
    _table = {"P14_ranges": "orders", "P15_freshness": "events"}.get(_name, "lineitem")
    _only = {"P07": {"distinct"}, "P10": {"moments"}, "P11": {"quartiles"}, "P12": {"moments"}, "P13": {"surrogates"}, "P14": {"ranges"}, "P15": {"ranges"}, "P18": {"moments"}}.get(_name[:3], set())
    _where = "days_since_latest IS NOT NULL" if _name == "P15_freshness" else "true"
    R.add(_name, f"SELECT {', '.join(_columns)} FROM ({profile_sql(_table)}) WHERE {_where}")(
        lambda spark, sf_dir, c=_columns, t=_table, o=_only, w=_where: profiled(spark, sf_dir, t, o).where(w).selectExpr(*c))


@R.add("P02_samples", """
WITH v AS (SELECT 'c_name' AS column_name, c_name AS v, c_custkey AS k FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment, c_custkey FROM customer),
r AS (SELECT column_name, v, row_number() OVER (PARTITION BY column_name ORDER BY k) AS position FROM v WHERE v IS NOT NULL)
SELECT column_name, position, CASE WHEN length(v) > 12 THEN substr(v, 1, 11) || '…' ELSE v END AS sample FROM r WHERE position <= 5""")  # fmt: skip
def samples(spark, sf_dir):
    return pf.sample_values(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment", "c_custkey"), ["c_custkey"], length=12).where("column_name <> 'c_custkey'")


@R.add("P03_value_patterns", r"""
WITH v AS (SELECT trim(text) AS v FROM (SELECT text, doc_id FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 100) WHERE trim(text) <> ''),
k AS (SELECT v, regexp_matches(v, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS email, regexp_matches(v, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') AS ssn,
  list_transform(string_split(trim(regexp_replace(replace(v, ',', ' '), '\s+', ' ', 'g')), ' '), lambda x: trim(x, '.')) AS t FROM v)
SELECT count(*) AS scanned, count_if(email) AS email, count_if(ssn AND NOT email) AS ssn,
  count_if(NOT email AND NOT ssn AND NOT contains(v, '@') AND length(v) <= 80 AND NOT regexp_matches(v, '[0-9]') AND len(t) BETWEEN 2 AND 4 AND len(list_filter(t, lambda x: NOT regexp_full_match(x, '[A-Za-z][A-Za-z\x27-]{1,29}'))) = 0) AS person_name FROM k""")  # fmt: skip
def value_patterns(spark, sf_dir):
    return pf.value_patterns(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@R.add("P04_person_names", r"""
WITH t AS (SELECT p_partkey, p_name, list_transform(string_split(trim(regexp_replace(replace(p_type || ' ' || p_brand, ',', ' '), '\s+', ' ', 'g')), ' '), lambda x: trim(x, '.')) AS t FROM part)
SELECT p_partkey, NOT regexp_matches(array_to_string(t, ' '), '[0-9]') AND len(t) BETWEEN 2 AND 4 AND len(list_filter(t, lambda x: NOT regexp_full_match(x, '[A-Za-z][A-Za-z\x27-]{1,29}'))) = 0 AS is_name FROM t""")  # fmt: skip
def person_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", pf.person_name(F.concat_ws(" ", "p_type", "p_brand")).alias("is_name"))


@R.add("P05_row_counts", "SELECT count(*) AS row_count, least(count(*), 10000) AS profiled_row_count FROM orders")
def row_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("row_count")).withColumn("profiled_row_count", F.least("row_count", F.lit(10000)))


@R.add("P08_duplicate_rows", "SELECT CAST(sum(n - 1) AS BIGINT) AS dup_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber, l_quantity, l_returnflag)")
def duplicate_rows(spark, sf_dir):
    return pf.duplicate_rows(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"))


@R.add("P09_missing_cells", f"SELECT max(row_count) AS row_count, count(*) AS column_count, round(avg(null_count / greatest(row_count, 1)) * 100, 2) AS missing_pct FROM ({profile_sql('events')})")
def missing_cells(spark, sf_dir):
    return pf.table_summary(profiled(spark, sf_dir, "events", set()))


@R.add("P16_date_coercion", "SELECT order_date, plain FROM (SELECT strftime(o_orderdate, '%Y-%m-%d')::DATE::TIMESTAMP AS order_date, 'x' || o_orderkey AS plain FROM orders)")
def date_coercion(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), F.concat(F.lit("x"), F.col("o_orderkey")).alias("plain"))
    return pf.coerced_dates(text)


@R.add("P17_correlated_pairs", """
SELECT column_a, column_b, r FROM (
  SELECT 'l_quantity' AS column_a, 'price' AS column_b, round(corr(l_quantity, l_quantity * 3 + l_tax), 4) AS r FROM lineitem UNION ALL
  SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 4) FROM lineitem UNION ALL
  SELECT 'price', 'l_tax', round(corr(l_quantity * 3 + l_tax, l_tax), 4) FROM lineitem) WHERE abs(r) >= 0.95""")  # fmt: skip
def correlated_pairs(spark, sf_dir):
    return pf.correlated_pairs(table(spark, sf_dir, "lineitem").selectExpr("l_quantity", "l_quantity * 3 + l_tax AS price", "l_tax"))


@R.add("P19_near_constant", """
SELECT column_name, round(max(n) / sum(n), 6) AS top_share FROM (
  SELECT 'l_returnflag' AS column_name, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL)
WHERE v IS NOT NULL GROUP BY column_name""")  # fmt: skip
def near_constant(spark, sf_dir):
    shares = pf.top_shares(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])
    return shares.select("column_name", F.round("top_share", 6).alias("top_share"))


@R.add("P22_co_missing", """
WITH o AS (SELECT o_orderkey % 7 = 0 AS a, o_orderkey % 7 = 0 AS b, o_orderkey % 5 = 0 AS c FROM orders),
n AS (SELECT count_if(a) AS a, count_if(b) AS b, count_if(c) AS c, count_if(a AND b) AS ab, count_if(a AND c) AS ac, count_if(b AND c) AS bc FROM o),
g AS (SELECT 'a' || CASE WHEN ab > 0.8 * a THEN ',b' ELSE '' END || CASE WHEN ac > 0.8 * a THEN ',c' ELSE '' END AS columns FROM n UNION ALL SELECT CASE WHEN bc > 0.8 * b AND ab <= 0.8 * a AND ac <= 0.8 * a THEN 'b,c' END FROM n)
SELECT columns FROM g WHERE columns LIKE '%,%'""")
def co_missing(spark, sf_dir):
    base = table(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 END AS a", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 2 END AS b", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 3 END AS c")
    return spark.createDataFrame([(",".join(g),) for g in pf.co_missing_groups(base)], "columns string")


@R.add("T05_systematic_sample", """
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
WHERE (rn - 1) % CAST(ceil(n / 1000) AS BIGINT) = 0 ORDER BY rn LIMIT 1000""")  # fmt: skip
def systematic_sample(spark, sf_dir):
    return pf.systematic_sample(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 1000)


@R.add("T07_ordered_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def ordered_head(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@R.add("T03_exact_count", "SELECT count(*) AS row_count FROM lineitem")
def exact_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("row_count"))


# Rules and scores.
ASSESSED = ["customer", "orders", "part", "labelled"]


#: A dictionary of some of the assessed tables: table, column, definition, declared type, consent, refresh.
DICTIONARY = [
    ("customer", "C_CUSTKEY", "key of a customer", "int", "approved", "nightly"), ("customer", "c_name", "name", "int", None, None), ("customer", "c_missing", "", "string", None, None),
    ("orders", "o_orderkey", "key of an order", "int", "denied", "on request"), ("labelled", "doc_id", None, "int", None, "every 2 hours"),
]
DICTIONARY_SCHEMA = "table_name string, column_name string, definition string, data_type string, consent string, refresh string"


def source_of(spark, sf_dir, name):
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS label", "toxic AS review_result") if name == "labelled" else table(spark, sf_dir, name)


#: Parts of a profile that facts are made of.
FACT_PARTS = {"distinct", "moments", "surrogates", "ranges"}


def facts(spark, sf_dir):
    """A row of facts for each assessed table: a lazy frame over the tables themselves."""
    words = spark.createDataFrame(DICTIONARY, DICTIONARY_SCHEMA)
    tables = {t: source_of(spark, sf_dir, t) for t in ASSESSED}
    given = ms.measured(tables, {t: [next(iter(COLUMNS[t]))] for t in ASSESSED}).union(ms.dictionary_facts(words, {t: COLUMNS[t] for t in ASSESSED}))
    return rl.facts(pf.table_profiles(tables, F.lit(REF).cast("timestamp"), FACT_PARTS), given)


V_BINS = """(SELECT CASE WHEN r > 1 AND k > 1 THEN round(sqrt(greatest(0, phi2 - (r - 1) * (k - 1) / (m - 1)) / nullif(least(r - (r - 1) * (r - 1) / (m - 1), k - (k - 1) * (k - 1) / (m - 1)) - 1, 0)), 3) END
FROM (SELECT sum(n * n / (nx * ny)) - 1 AS phi2, count(DISTINCT x)::DOUBLE AS r, count(DISTINCT y)::DOUBLE AS k, sum(n) AS m FROM (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny
FROM (SELECT x, y, count(*)::DOUBLE AS n FROM (SELECT {x} AS x, {y} AS y FROM {t}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY x, y))))"""


def bin_sql(t: str, c: str, kind: str) -> str:
    n, whole = f"(SELECT count(DISTINCT {c}) FROM {t})", f"CAST({c} AS VARCHAR)"
    if kind not in ("int", "float"):
        return f"CASE WHEN {n} <= 50 THEN {whole} END"
    lo, width = f"(SELECT min({c})::DOUBLE FROM {t})", f"(SELECT (max({c})::DOUBLE - min({c})::DOUBLE) / 10 FROM {t})"
    return f"CASE WHEN {n} > 10 THEN CAST(CAST(least(floor(({c}::DOUBLE - {lo}) / {width}), 9) AS BIGINT) AS VARCHAR) ELSE {whole} END"


def association_sql(t: str, a: str, b: str, kinds: dict[str, str]) -> str:
    return V_BINS.format(x=bin_sql(t, a, kinds[a]), y=bin_sql(t, b, kinds[b]), t=t)


def measured_sql(name: str) -> dict[str, str]:
    """The measured facts of a table, by other means: scalar subqueries over the table itself."""
    t, kinds = VIEWS.get(name, name), COLUMNS[name]
    numbers = [c for c, k in kinds.items() if k in ("int", "float")]
    binned = [c for c, k in kinds.items() if k != "datetime"]
    pairs = lambda names: [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = lambda test, source=t: f"(SELECT CASE WHEN {test} THEN 1 ELSE 0 END FROM {source})"
    orgs = ", ".join(f"'{w}'" for w in pf.ORG_WORDS)
    first = next(iter(kinds))
    mismatch, personal = [], []
    for c, k in kinds.items():
        if k == "string":
            mismatch.append(one(f"count({c}) IN (0, count(try_cast({c} AS DOUBLE)), count(try_cast({c} AS TIMESTAMP)))"))
            words = rf"string_split(trim(regexp_replace(replace({c}, ',', ' '), '\s+', ' ', 'g')), ' ')"
            name_like = rf"len({words}) BETWEEN 2 AND 4 AND NOT regexp_matches({c}, '[0-9@]') AND len(list_filter({words}, lambda x: NOT regexp_full_match(x, '[A-Za-z][A-Za-z\x27-]{{1,29}}') OR lower(x) IN ({orgs}))) = 0"
            personal.append(one(f"count_if(regexp_matches({c}, '{pf.EMAIL_VALUE}') OR regexp_matches({c}, '{pf.SSN_VALUE}') OR {name_like}) > 0", f"(SELECT {c} FROM {t} WHERE {c} IS NOT NULL ORDER BY {first} LIMIT 100)"))
        else:
            mismatch.append(one(f"count({c}) = 0" + (f" OR count(DISTINCT {c}) <= 5" if k != "datetime" else "")))
    rows = [r for r in DICTIONARY if r[0] == name]
    known = [r for r in rows if r[1].lower() in kinds]
    return {
        "dup_rows": f"(SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}))",
        "near_constant": " + ".join(f"(SELECT count(*) FROM (SELECT max(n)::DOUBLE / sum(n) AS s FROM (SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})) WHERE s >= 0.95)" for c in kinds),
        "mismatched": " + ".join(mismatch), "pii_values": " + ".join(personal) or "0",
        "pearson_pairs": " + ".join(one(f"count(*) >= 20 AND NOT isnan(corr({a}, {b})) AND abs(round(corr({a}, {b}), 4)) >= 0.95") for a, b in pairs(numbers)) or "0",
        "co_missing": one(" OR ".join(f"count_if({a} IS NULL AND {b} IS NULL) > 0.8 * least(nullif(count_if({a} IS NULL), 0), nullif(count_if({b} IS NULL), 0))" for a, b in pairs(list(kinds)))),
        "phik_pairs": " + ".join(f"coalesce(CAST({association_sql(t, a, b, kinds)} >= 0.8 AS INTEGER), 0)" for a, b in pairs(binned)),
        "entries": str(len(rows)), "matched": str(len(known)), "documented": str(sum(bool((r[2] or "").strip()) for r in known)), "coverage": str(100.0 * len({r[1].lower() for r in known}) / len(kinds)),
        "dictionary_mismatches": str(sum(r[3] != kinds[r[1].lower()] for r in known)), "approved": str(sum(r[4] == "approved" for r in rows)), "denied": str(sum(r[4] == "denied" for r in rows)),
        "cadence_known": {"customer": "1", "labelled": "1"}.get(name, "0"),
    }


def facts_sql() -> str:
    found = rl.facts_sql(lambda p: f"regexp_matches(column_name, '{p}')", lambda c: f"epoch({c})")
    quasi = rl.QUASI.format(pii=f"regexp_matches(column_name, '{rl.PATTERNS['pii']}')")
    values = {t: measured_sql(t) for t in ASSESSED}
    given = ", ".join(f"CASE table_name {' '.join(f'WHEN {chr(39)}{t}{chr(39)} THEN {values[t][k]}' for t in ASSESSED)} END AS {k}" for k in rl.MEASURED if k != "quasi_product")
    return f"""SELECT table_name, {', '.join(f'{e} AS {k}' for k, e in found.items())}, coalesce(product(CASE WHEN place <= 3 THEN q END), 0) AS quasi_product, {given}
FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY q DESC NULLS LAST, ordinal) AS place FROM (SELECT *, {quasi} AS q FROM ({' UNION ALL '.join(profile_sql(t) for t in ASSESSED)}))) GROUP BY table_name"""


def checks_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT table_name, '{r.split('_')[0]}' AS dimension, '{r}' AS rule_id, '{s}' AS severity, {e} AS status FROM facts" + (' WHERE targets > 0 OR binary_columns > 0' if r.startswith("labels") else "") for r, (s, e) in rl.RULES.items())
    return f"WITH facts AS MATERIALIZED ({facts_sql()}), checks AS MATERIALIZED ({rows})"


POINTS = "CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 WHEN 'fail' THEN 0.0 END"
WEIGHT = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {w}" for d, w in rl.WEIGHTS.items()) + " END"


def scores_sql() -> str:
    return checks_sql() + f""", dims AS (SELECT table_name, dimension, coalesce(round_even(avg({POINTS}) * 100, 0), 0.0) AS score, {WEIGHT} AS weight FROM checks GROUP BY table_name, dimension),
blocked AS (SELECT table_name, count_if(severity = 'blocker' AND status = 'fail') AS blockers FROM checks GROUP BY table_name),
tables AS (SELECT table_name, CASE WHEN blockers > 0 THEN least(raw, 59) ELSE raw END AS score, blockers FROM (SELECT table_name, round_even(sum(score * weight) / sum(weight), 0) AS raw FROM dims GROUP BY table_name) JOIN blocked USING (table_name))"""


_CHECKS = checks_sql()
for _dimension in rl.WEIGHTS:
    R.add(f"rules_{_dimension}", _CHECKS + f" SELECT table_name, rule_id, severity, status FROM checks WHERE dimension = '{_dimension}'")(
        lambda spark, sf_dir, d=_dimension: rl.checks(facts(spark, sf_dir)).where(F.col("dimension") == d).select("table_name", "rule_id", "severity", "status"))

_SCORES = scores_sql()


@R.add("R02_dimension_score", _SCORES + " SELECT table_name, dimension, score, weight FROM dims")
def dimension_score(spark, sf_dir):
    return rl.dimension_scores(rl.checks(facts(spark, sf_dir))).select("table_name", "dimension", "score", "weight")


TIER = "CASE WHEN score >= 80 THEN 'green' WHEN score >= 60 THEN 'yellow' ELSE 'red' END"


@R.add("R03_table_score", _SCORES + f" SELECT table_name, score, {TIER} AS tier, CASE WHEN blockers > 0 THEN 'gated' WHEN score >= 80 THEN 'ready' ELSE 'conditional' END AS klass, blockers FROM tables")
def table_score(spark, sf_dir):
    return rl.table_scores(rl.checks(facts(spark, sf_dir)))


@R.add("R06_schema_rollup", _SCORES + " SELECT dimension, round_even(avg(score), 0) AS score, count(*) AS tables FROM dims GROUP BY dimension")
def schema_rollup(spark, sf_dir):
    return rl.dimension_scores(rl.checks(facts(spark, sf_dir))).groupBy("dimension").agg(F.bround(F.avg("score"), 0).alias("score"), F.count(F.lit(1)).alias("tables"))


@R.add("R06_worst_checks", _CHECKS + """ SELECT rule_id, CASE max(CASE status WHEN 'deferred' THEN 3 WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 3 THEN 'deferred' WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status,
count_if(status <> 'pass') AS tables FROM checks GROUP BY rule_id""")  # fmt: skip
def worst_checks(spark, sf_dir):
    return rl.worst_checks(rl.checks(facts(spark, sf_dir)))


@R.add("R07_finding_uid", _CHECKS + " SELECT table_name, rule_id, substr(sha1(table_name || '|' || rule_id || '|a|b'), 1, 12) AS uid FROM checks WHERE status = 'fail'")
def finding_uid(spark, sf_dir):
    found = rl.checks(facts(spark, sf_dir)).where("status = 'fail'")
    return found.select("table_name", "rule_id", rl.finding_uid(F.col("table_name"), F.col("rule_id"), F.array(F.lit("b"), F.lit("a"))).alias("uid"))


@R.add("R10_top_priorities", _CHECKS + f""" SELECT rule_id, dimension, severity FROM (SELECT rule_id, dimension, severity, row_number() OVER (PARTITION BY rule_id ORDER BY sev, bad, -w, table_name) AS n, sev, bad, w, table_name FROM (
SELECT *, CASE WHEN severity = 'blocker' THEN 0 ELSE 1 END AS sev, CASE WHEN status = 'fail' THEN 0 ELSE 1 END AS bad, {WEIGHT} AS w FROM checks WHERE status IN ('fail', 'warn'))) WHERE n = 1 ORDER BY sev, bad, -w, table_name, rule_id LIMIT 5""")  # fmt: skip
def top_priorities(spark, sf_dir):
    from pyspark.sql import Window

    found = rl.checks(facts(spark, sf_dir)).where("status IN ('fail', 'warn')").withColumns({
        "sev": F.when(F.col("severity") == "blocker", 0).otherwise(1), "bad": F.when(F.col("status") == "fail", 0).otherwise(1), "w": -F.expr(WEIGHT)})
    first = F.row_number().over(Window.partitionBy("rule_id").orderBy("sev", "bad", "w", "table_name"))
    return found.withColumn("n", first).where("n = 1").orderBy("sev", "bad", "w", "table_name", "rule_id").limit(5).select("rule_id", "dimension", "severity")


@R.add("R11_action_groups", _CHECKS + """ SELECT rule_id, min(CASE severity WHEN 'blocker' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS severity_rank, count(DISTINCT table_name) AS tables, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS names
FROM checks WHERE status IN ('fail', 'warn') GROUP BY rule_id""")  # fmt: skip
def action_groups(spark, sf_dir):
    rank = F.when(F.col("severity") == "blocker", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    found = rl.checks(facts(spark, sf_dir)).where("status IN ('fail', 'warn')").groupBy("rule_id")
    return found.agg(F.min(rank).alias("severity_rank"), F.count_distinct("table_name").alias("tables"), F.array_join(F.array_sort(F.collect_set("table_name")), ",").alias("names"))


@R.add("R15_lens_scores", _CHECKS + " SELECT lens, count_if(status = 'pass') AS passed, count(*) AS total FROM (SELECT status, unnest(CASE dimension " + " ".join(f"WHEN '{d}' THEN {x}" for d, x in rl.LENSES.items()) + " END) AS lens FROM checks WHERE status <> 'deferred') GROUP BY lens")
def lens_scores(spark, sf_dir):
    return rl.lens_scores(rl.checks(facts(spark, sf_dir)))


@R.add("R16_what_if", _SCORES + f""", fixed AS (SELECT table_name, dimension, coalesce(round_even(avg(CASE WHEN rule_id = 'schema_audit' THEN 1.0 ELSE {POINTS} END) * 100, 0), 0.0) AS score, {WEIGHT} AS weight FROM checks GROUP BY table_name, dimension)
SELECT table_name, t.score AS before, CASE WHEN blockers > 0 THEN least(f.raw, 59) ELSE f.raw END AS after FROM tables t JOIN (SELECT table_name, round_even(sum(score * weight) / sum(weight), 0) AS raw FROM fixed GROUP BY table_name) f USING (table_name)""")  # fmt: skip
def what_if(spark, sf_dir):
    return rl.simulate(rl.checks(facts(spark, sf_dir)), "schema_audit")


TYPED = "SELECT CAST(o_orderkey AS VARCHAR) AS key_text, strftime(o_orderdate, '%Y-%m-%d') AS date_text, o_orderstatus, o_totalprice, o_orderkey % 3 AS few, CAST(NULL AS VARCHAR) AS nothing FROM orders"


@R.add("P20_type_mismatch", f"""SELECT * FROM (SELECT 'key_text' AS column_name, 'string' AS stored_as, CASE WHEN count(try_cast(key_text AS DOUBLE)) = count(*) THEN 'Numeric' ELSE 'Text' END AS detected_as FROM ({TYPED})
UNION ALL SELECT 'date_text', 'string', CASE WHEN count(try_cast(date_text AS TIMESTAMP)) = count(*) THEN 'DateTime' ELSE 'Text' END FROM ({TYPED}) UNION ALL SELECT 'few', 'int', CASE WHEN count(DISTINCT few) <= 5 THEN 'Categorical' ELSE 'Numeric' END FROM ({TYPED})
UNION ALL SELECT 'nothing', 'string', CASE WHEN count(nothing) = 0 THEN 'Unsupported' ELSE 'Text' END FROM ({TYPED}))""")  # fmt: skip
def type_mismatch(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return ms.type_mismatches(o.selectExpr("CAST(o_orderkey AS STRING) AS key_text", "date_format(o_orderdate, 'yyyy-MM-dd') AS date_text", "o_orderstatus", "o_totalprice", "o_orderkey % 3 AS few", "CAST(NULL AS STRING) AS nothing"))


PARTS = "(SELECT p_size, p_size * 2 + p_partkey % 2 AS doubled, p_brand, substr(p_brand, 1, 7) AS maker, p_retailprice FROM part)"
PART_KINDS = {"p_size": "int", "doubled": "int", "p_brand": "string", "maker": "string", "p_retailprice": "float"}


@R.add("P21_associated_pairs", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {association_sql(PARTS, a, b, PART_KINDS)} AS v" for i, a in enumerate(PART_KINDS) for b in list(PART_KINDS)[i + 1 :]) + ") WHERE v >= 0.8")
def associated_pairs(spark, sf_dir):
    return ms.associated_pairs(table(spark, sf_dir, "part").selectExpr("p_size", "p_size * 2 + p_partkey % 2 AS doubled", "p_brand", "substr(p_brand, 1, 7) AS maker", "p_retailprice"))


@R.add("P21_phi_k")
def phi_k(spark, sf_dir):
    """Inverting a normal distribution has no SQL; the tests integrate it by other means."""
    part = table(spark, sf_dir, "part").selectExpr("p_size", "p_size * 2 + p_partkey % 2 AS doubled", "p_brand", "substr(p_brand, 1, 7) AS maker", "p_retailprice")
    return pk.phi_k_pairs(part, 0.0)


QUERIES, ORACLE = R.queries, R.oracle
