"""Metadata quality, reconciliation, capabilities and purpose verdicts over the assessed tables and a dictionary of their columns.

The dictionary is derived from the profiles of the tables: what is declared of a column depends on its place, kind and
counts, so that it grows with the tables and agrees with them in part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import capabilities as cp
from loomwright.operators import profile as pf
from loomwright.operators import reconcile as rc
from loomwright.operators import register as rg
from loomwright.operators import rules as rl
from loomwright.operators import verdicts as vd
from loomwright.plans.profile_queries import _CHECKS, _SCORES, ASSESSED, COLUMNS, REF, TIER, VIEWS, facts, profile_sql, source_of
from loomwright.plans.registry import Registry, table

R = Registry()
#: A table with a column of nulls only, one with some, and one named like personal data.
ODD = "SELECT o_orderkey, o_custkey, CAST(NULL AS {text}) AS note, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus AS email_state, o_orderdate AS placed_at FROM orders"
COLUMNS["declared"] = {"o_orderkey": "int", "o_custkey": "int", "note": "string", "price": "float", "email_state": "string", "placed_at": "datetime"}
VIEWS["declared"] = "(" + ODD.format(text="VARCHAR") + ")"
TABLES = [*ASSESSED, "declared"]
LONG = "'Values of ' || column_name || ' as they were loaded' || repeat(', without gaps', 8)"
#: What the dictionary declares, in SQL that both engines read, over the columns of a profile.
ENTRY = {
    "definition": f"CASE WHEN table_name = 'part' THEN CASE WHEN ordinal = 4 THEN ' ' WHEN ordinal = 5 THEN 'short' END WHEN ordinal % 3 < 2 THEN {LONG} END",
    "description": "CASE WHEN ordinal = 0 AND table_name <> 'part' THEN 'TBD' WHEN ordinal = 2 THEN column_name END",
    "business_owner": "CASE WHEN table_name IN ('orders', 'customer') AND ordinal > 0 THEN ' sales ' WHEN table_name = 'part' AND ordinal = 1 THEN 'Tbd' END",
    "data_steward": "CASE WHEN table_name = 'orders' AND ordinal = 2 THEN 'steward ' || column_name END",
    "usage_context": "CASE WHEN table_name <> 'part' AND ordinal = 1 THEN 'reporting' ELSE '' END",
    "security_classification": "CASE WHEN table_name = 'part' THEN 'N/A' WHEN ordinal >= 1 THEN 'internal' END",
    "pii_flag": "CASE WHEN table_name = 'customer' THEN 'N' WHEN table_name = 'declared' THEN 'no' WHEN table_name = 'orders' AND ordinal < 2 THEN 'Y' END",
    "retention_policy": "CASE WHEN table_name = 'orders' THEN '7 years' END",
    "consent_basis": "CASE WHEN table_name = 'customer' AND ordinal = 3 THEN 'contract' END",
    "ai_ml_usage_approval": "CASE WHEN table_name IN ('orders', 'labelled') AND ordinal = 1 THEN 'approved' END",
    "refresh_frequency": "CASE WHEN table_name = 'orders' AND ordinal = 5 THEN 'nightly' END",
    "last_synced_at": "CASE WHEN ordinal = 0 THEN '2029-12-20T00:00:00Z' WHEN ordinal = 1 THEN ' 2029-08-01T12:00:00Z ' WHEN ordinal = 2 THEN '2020-01-01T00:00:00' WHEN ordinal = 3 THEN 'long ago' END",
    "primary_foreign_key": "CASE WHEN ordinal = 0 THEN 'pk' WHEN column_name LIKE '%custkey' THEN 'FK to customer' WHEN ordinal = 2 AND table_name = 'orders' THEN 'Primary key' END",
    "data_type_declared": "CASE WHEN ordinal % 4 = 3 THEN 'VarChar' WHEN ordinal = 1 THEN 'money' ELSE ' ' || CASE dtype WHEN 'float' THEN 'number' WHEN 'datetime' THEN 'date' ELSE dtype END END",
    "nullable_declared": "CASE WHEN ordinal > 1 THEN 'not null' WHEN ordinal = 1 THEN 'yes' END",
    "valid_values_range": "CASE ordinal WHEN 0 THEN '9-1' WHEN 1 THEN '1..5' WHEN 2 THEN ' 7.5 .. 7.25' WHEN 3 THEN 'low-high' WHEN 4 THEN '5,4' END",
    "cardinality_declared": "CASE WHEN ordinal = 0 THEN '' || unique_count WHEN ordinal % 3 = 1 THEN '' || (unique_count * 2) WHEN ordinal = 2 THEN 'many' WHEN ordinal = 3 THEN '0' END",
    "field_role": "CASE WHEN column_name = 'note' THEN 'Feature' WHEN ordinal = 1 THEN 'deprecated' END",
    "source_system": "CASE WHEN table_name = 'orders' AND ordinal = 0 THEN 'shop' END",
    "lineage": "CASE WHEN table_name IN ('orders', 'labelled') AND ordinal = 1 THEN 'landing' END",
}
#: Tables of the profile that have no entries, and an entry of a column that no table has.
SILENT = "'part'"


def observed(spark, sf_dir, names=tuple(TABLES)):
    odd = lambda: table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "CAST(NULL AS STRING) AS note", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price", "o_orderstatus AS email_state", "o_orderdate AS placed_at")
    tables = {t: odd() if t == "declared" else source_of(spark, sf_dir, t) for t in names}
    return pf.table_profiles(tables, F.lit(REF).cast("timestamp"), {"distinct"})


def dictionary(profile):
    """An entry for each column, and one for a column that is gone; names in capitals for every other."""
    named = profile.selectExpr("table_name", "ordinal AS position", "CASE WHEN ordinal % 2 = 0 THEN upper(column_name) ELSE column_name END AS column_name", *[f"{e} AS {a}" for a, e in ENTRY.items()])
    blank = ", ".join(f"CAST(NULL AS STRING) AS {a}" if a != "valid_values_range" else "'3-2' AS valid_values_range" for a in ENTRY)
    gone = profile.where("ordinal = 0").selectExpr("table_name", "100 AS position", "'gone_' || table_name AS column_name", *blank.split(", "))
    return named.unionByName(gone)


PROFILES = "(" + " UNION ALL ".join(profile_sql(t) for t in TABLES) + ")"
ENTRIES = f"""p AS MATERIALIZED (SELECT * FROM {PROFILES}), e AS MATERIALIZED (SELECT table_name, ordinal AS position, CASE WHEN ordinal % 2 = 0 THEN upper(column_name) ELSE column_name END AS column_name, {', '.join(f'{e} AS {a}' for a, e in ENTRY.items())} FROM p
UNION ALL SELECT table_name, 100, 'gone_' || table_name, {', '.join("'3-2'" if a == 'valid_values_range' else 'NULL' for a in ENTRY)} FROM p WHERE ordinal = 0)"""
BARE = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def first_sql(field: str) -> str:
    names = rg.FIRST[field]
    value = "CASE " + " ".join(f"WHEN {n} <> '' THEN {n}" for n in names) + " END"
    more = f" AND upper({value}) LIKE '%FK%'" if field == "T4" else ""
    return f"(SELECT arg_min({BARE.format(x=value)}, position) FROM e WHERE e.table_name = t.table_name AND {BARE.format(x=value)} <> ''{more})"


def covered_sql(field: str) -> str:
    some = " OR ".join(f"{BARE.format(x=n)} <> ''" for n in rg.COVERED[field])
    return f"(SELECT count(*) FROM e WHERE e.table_name = t.table_name AND ({some}))"


def field_sql() -> str:
    """44 rows a table, a SELECT for each field; validity, escalation and points by CASE and EXISTS."""
    rows = []
    for place, (field, _, category, severity) in enumerate(rg.REGISTER):
        if field in rg.COVERED:
            value, covered, total = "NULL::VARCHAR", covered_sql(field), "cols"
        else:
            value = {"T1": "table_name", "O6": "CAST(n AS VARCHAR)"}.get(field, first_sql(field) if field in rg.FIRST else "NULL::VARCHAR")
            covered, total = "NULL::BIGINT", "NULL::BIGINT"
        rows.append(f"SELECT table_name, {place} AS place, '{field}' AS field_id, '{category}' AS category, '{severity}' AS severity, {value} AS value, {covered} AS covered, {total} AS total FROM t")
    quiet = lambda f, test: f"NOT EXISTS (SELECT 1 FROM w g WHERE g.table_name = w.table_name AND g.field_id = '{f}' AND NOT absent AND NOT ({test}))".replace("absent", "g.absent")
    holders = ", ".join(f"'{x}'" for x in rg.PLACEHOLDERS)
    return f"""WITH {ENTRIES}, t AS (SELECT table_name, max(row_count) AS n, count(*) AS cols FROM p GROUP BY table_name), raw AS MATERIALIZED ({' UNION ALL '.join(rows)}),
w AS (SELECT *, CASE WHEN covered IS NULL THEN value IS NULL ELSE covered = 0 END AS absent FROM raw),
v AS (SELECT *, CASE WHEN field_id IN ('T1', 'O6') THEN true WHEN absent THEN false WHEN covered IS NOT NULL THEN total = 0 OR covered >= 0.5 * total WHEN field_id = 'B2' THEN length(value) >= 120 ELSE lower(value) NOT IN ({holders}) END AS valid,
CASE WHEN field_id IN ('B17', 'B21') AND {quiet('B13', 'g.covered > 0')} THEN 'ESC-1' WHEN field_id = 'O5' AND {quiet('B7', "lower(g.value) = 'critical'")} THEN 'ESC-2'
WHEN field_id = 'O3' AND {quiet('O3', "lower(g.value) <> 'full_refresh'")} THEN 'ESC-3' WHEN field_id = 'B20' AND {quiet('B14', "lower(g.value) <> 'none'")} THEN 'ESC-4' END AS escalation FROM w),
s AS (SELECT *, CASE WHEN escalation IS NULL THEN severity WHEN escalation = 'ESC-3' THEN 'MEDIUM' ELSE 'HIGH' END AS effective FROM v),
f AS MATERIALIZED (SELECT *, CASE WHEN valid THEN round_even(possible * coalesce(covered / greatest(total, 1), 1.0), 2) ELSE 0.0 END AS earned, CASE WHEN absent THEN 'absent' WHEN valid THEN 'present' ELSE 'invalid' END AS state
FROM (SELECT *, CASE effective WHEN 'HIGH' THEN 3.0 WHEN 'MEDIUM' THEN 2.0 ELSE 1.0 END::DOUBLE AS possible FROM s)),
c AS (SELECT table_name, category, round_even(sum(earned) / sum(possible), 4) AS score, sum(possible) AS possible, round_even(sum(earned), 2) AS earned, count_if(state = 'present') AS present, count_if(valid) AS valid, count(*) AS fields FROM f GROUP BY table_name, category),
q AS (SELECT table_name, max(score) FILTER (category = 'business') AS business, max(score) FILTER (category = 'operational') AS operational, max(score) FILTER (category = 'technical') AS technical, max(score) FILTER (category = 'lineage') AS lineage FROM c GROUP BY table_name)"""


FIELDS = field_sql()


def fields(spark, sf_dir, names=tuple(TABLES)):
    profile = observed(spark, sf_dir, names)
    tables = profile.groupBy("table_name").agg(F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"))
    return rg.field_quality(tables, dictionary(profile))


@R.add("R13a_fields", FIELDS + " SELECT table_name, field_id, CASE WHEN absent THEN 'absent' ELSE 'present' END AS status, value, covered, total FROM f")
def extracted_fields(spark, sf_dir):
    return fields(spark, sf_dir).select("table_name", "field_id", "status", "value", "covered", "total")


@R.add("R13b_validation", FIELDS + " SELECT table_name, field_id, state, valid, possible, earned FROM f")
def validation(spark, sf_dir):
    return fields(spark, sf_dir).select("table_name", "field_id", "state", "valid", "possible", "earned")


@R.add("R13c_escalations", FIELDS + " SELECT table_name, field_id, effective, escalation FROM f")
def escalations(spark, sf_dir):
    return fields(spark, sf_dir).select("table_name", "field_id", "effective", "escalation")


@R.add("R13_categories", FIELDS + " SELECT table_name, category, score, possible, earned, present, valid, fields FROM c")
def categories(spark, sf_dir):
    return rg.category_scores(fields(spark, sf_dir))


@R.add("R13_metadata_quality", FIELDS + """ SELECT table_name, CASE WHEN red THEN 'RED' WHEN yellow THEN 'YELLOW' ELSE 'GREEN' END AS verdict, business, operational, technical, lineage, round_even((business + operational + technical + lineage) / 4, 4) AS overall,
round_even((business + operational + technical + lineage) / 4 * 100, 0) AS quality, high_failing FROM q JOIN (SELECT table_name, bool_or(NOT valid AND effective = 'HIGH' AND coalesce(covered / greatest(total, 1) < CASE field_id WHEN 'B13' THEN 1.0 ELSE 0.95 END, true)) AS red,
bool_or(NOT valid AND effective = 'MEDIUM') AS yellow, count_if(NOT valid AND effective = 'HIGH') AS high_failing FROM f GROUP BY table_name) USING (table_name)""")  # fmt: skip
def metadata_quality(spark, sf_dir):
    return rg.metadata_quality(fields(spark, sf_dir))


@R.add("R13_remediation", FIELDS + """ SELECT table_name, row_number() OVER (PARTITION BY table_name ORDER BY -possible, place) AS priority, field_id, effective, round_even(possible - earned, 2) AS recoverable, CASE category WHEN 'business' THEN 'business' ELSE 'platform' END AS owner
FROM f WHERE NOT valid""")  # fmt: skip
def remediation(spark, sf_dir):
    return rg.remediation(fields(spark, sf_dir))


def joined(first: str, second: str) -> str:
    """Two WITH clauses as one."""
    return first + ", " + second.removeprefix("WITH ")


@R.add("R14_metadata_retune", joined(_SCORES, FIELDS) + f""", retuned AS (SELECT table_name, sum(CASE WHEN dimension = 'metadata' THEN round_even((business + operational + technical + lineage) / 4 * 100, 0) ELSE score END * weight) / sum(weight) AS mean FROM dims JOIN q USING (table_name) GROUP BY table_name),
capped AS (SELECT table_name, CASE WHEN blockers > 0 THEN least(round_even(mean, 0), 59) ELSE round_even(mean, 0) END AS score, blockers FROM retuned JOIN blocked USING (table_name))
SELECT table_name, CAST(score AS DOUBLE) AS score, {TIER} AS tier, CASE WHEN blockers > 0 THEN 'gated' WHEN score >= 80 THEN 'ready' ELSE 'conditional' END AS klass, blockers FROM capped""")  # fmt: skip
def metadata_retune(spark, sf_dir):
    quality = rg.metadata_quality(fields(spark, sf_dir, tuple(ASSESSED))).select("table_name", "quality")
    return vd.retuned(rl.checks(facts(spark, sf_dir)), quality)


TYPE_ROWS = ", ".join(f"('{t}', '{k}')" for t, kinds in rc.TYPES.items() for k in kinds)
NOW = f"TIMESTAMP '{REF}'"


@R.add("R18_reconcile", f"""WITH {ENTRIES}, d AS (SELECT * FROM e WHERE table_name <> {SILENT}), types(declared, kind) AS (VALUES {TYPE_ROWS}),
m AS (SELECT p.*, d.* EXCLUDE (table_name, column_name, position) FROM p JOIN d ON p.table_name = d.table_name AND lower(p.column_name) = lower(d.column_name)),
r AS (SELECT table_name, column_name, trim(valid_values_range) AS v, CASE WHEN contains(valid_values_range, '-') THEN '-' WHEN contains(valid_values_range, '..') THEN '..' WHEN contains(valid_values_range, ',') THEN ',' END AS mark FROM d),
y AS (SELECT table_name, column_name, last_synced_at, floor((epoch({NOW}) - epoch(try_cast(replace(trim(last_synced_at), 'Z', '') AS TIMESTAMP))) / 86400) AS days FROM d WHERE trim(last_synced_at) LIKE '%Z')
SELECT table_name, column_name, 'data_type' AS field, data_type_declared AS declared, dtype AS observed, 'warning' AS severity, 'confirmed' AS status FROM m WHERE lower(trim(data_type_declared)) IN (SELECT declared FROM types) AND NOT EXISTS (SELECT 1 FROM types WHERE types.declared = lower(trim(data_type_declared)) AND kind = dtype)
UNION ALL SELECT table_name, column_name, 'nullable', 'NOT NULL', null_count || ' nulls (' || printf('%.1f', null_pct) || '%)', 'warning', 'confirmed' FROM m WHERE upper(trim(nullable_declared)) IN ('N', 'NO', 'FALSE', 'NOT NULL') AND null_count > 0
UNION ALL SELECT table_name, column_name, 'primary_key', 'PK', unique_count || '/' || row_count || ' unique', 'warning', 'confirmed' FROM m WHERE upper(trim(primary_foreign_key)) IN ('PK', 'PRIMARY', 'PRIMARY KEY') AND unique_count < row_count
UNION ALL SELECT table_name, column_name, 'cardinality', '' || k, '' || unique_count, 'warning', 'confirmed' FROM (SELECT *, try_cast(cardinality_declared AS BIGINT) AS k FROM m) WHERE k > 0 AND unique_count > 0 AND abs(unique_count - k) > 0.1 * k
UNION ALL SELECT table_name, column_name, 'field_role', field_role, '100% null', 'warning', 'confirmed' FROM m WHERE null_count = row_count AND field_role <> '' AND lower(trim(field_role)) NOT IN ('deprecated', 'unused', 'archived')
UNION ALL SELECT table_name, column_name, CASE WHEN regexp_matches(column_name, '{rl.PATTERNS["pii"]}') THEN 'pii_flag' ELSE 'pii_flag_values' END, 'No PII', CASE WHEN regexp_matches(column_name, '{rl.PATTERNS["pii"]}') THEN 'name suggests personal data' ELSE 'values not checked' END,
  CASE WHEN regexp_matches(column_name, '{rl.PATTERNS["pii"]}') THEN 'warning' ELSE 'info' END, CASE WHEN regexp_matches(column_name, '{rl.PATTERNS["pii"]}') THEN 'confirmed' ELSE 'could_not_verify' END FROM m WHERE upper(trim(pii_flag)) IN ('N', 'NO', 'FALSE')
UNION ALL SELECT table_name, column_name, 'valid_values_range', v, '(internal check)', 'warning', 'confirmed' FROM r WHERE try_cast(trim(substr(v, 1, position(mark IN v) - 1)) AS DOUBLE) > try_cast(trim(substr(v, position(mark IN v) + length(mark))) AS DOUBLE)
UNION ALL SELECT table_name, column_name, 'last_synced_at', last_synced_at, CAST(days AS BIGINT) || ' days old', 'warning', 'confirmed' FROM y WHERE days > 90
UNION ALL SELECT {SILENT}, '*', 'reconciliation', '(no metadata uploaded)', '(profile only)', 'info', 'could_not_verify'""")  # fmt: skip
def reconcile(spark, sf_dir):
    """One table has no entries; the others' agree with them in part."""
    profile = observed(spark, sf_dir)
    return rc.reconciled(profile, dictionary(profile).where(f"table_name <> {SILENT}"), F.lit(REF).cast("timestamp"))


def status_sql(rule: str) -> str:
    return f"coalesce(max(status) FILTER (rule_id = '{rule}'), 'missing') AS {rule}"


STATUSES = ", ".join(map(status_sql, cp.READ))
LEVELS = f"""{joined(_CHECKS, 'WITH ' + ENTRIES)}, st AS (SELECT table_name, {STATUSES} FROM checks GROUP BY table_name),
fl AS (SELECT table_name, count(*) AS entry_rows, coalesce(bool_or(ai_ml_usage_approval <> ''), false) AS approved_use, coalesce(bool_or(lineage <> ''), false) OR coalesce(bool_or(source_system <> ''), false) AS traced, coalesce(bool_or(business_owner <> ''), false) OR coalesce(bool_or(data_steward <> ''), false) AS owned FROM e GROUP BY table_name),
a AS (SELECT st.*, n, coverage, pearson_pairs, texts, entry_rows, approved_use, traced, owned, [ops_watermark, ops_partition, ops_cadence] AS ops, [features_near_constant, features_infinites, features_cardinality] AS feats, [stats_no_constants, stats_outliers, stats_multicollinearity] AS stats,
  CASE WHEN NOT traced AND NOT owned THEN 1 WHEN traced AND owned THEN 3 ELSE 2 END AS line FROM st JOIN facts USING (table_name) JOIN fl USING (table_name)),
levels AS MATERIALIZED (SELECT table_name, unnest(['SEM', 'JOIN', 'GOV', 'AGG', 'ACC', 'FRS', 'LBL', 'LKG', 'SIG', 'STA', 'TMP', 'VOL', 'LIN', 'TXT']) AS capability, CAST(unnest([
  CASE WHEN coverage >= 90 THEN 4 WHEN coverage >= 70 THEN 3 WHEN coverage >= 40 THEN 2 ELSE 1 END,
  CASE schema_pk WHEN 'pass' THEN CASE WHEN pearson_pairs > 0 THEN 3 ELSE 2 END WHEN 'warn' THEN 1 ELSE 0 END,
  CASE WHEN privacy_column_names = 'fail' THEN 0 WHEN privacy_values = 'deferred' THEN 1 WHEN privacy_consent = 'pass' AND privacy_column_names = 'pass' THEN CASE WHEN approved_use THEN 4 ELSE 3 END ELSE 2 END,
  CASE WHEN quality_duplicates = 'fail' THEN 0 WHEN 'warn' IN (quality_duplicates, quality_surrogates) THEN 1 WHEN quality_duplicates = 'pass' AND quality_surrogates = 'pass' AND schema_pk = 'pass' THEN 3 ELSE 2 END,
  CASE len(list_filter(ops, lambda x: x = 'pass')) WHEN 3 THEN 4 WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END,
  CASE WHEN temporal_present = 'fail' THEN 0 ELSE CASE temporal_freshness WHEN 'fail' THEN 1 WHEN 'pass' THEN CASE WHEN temporal_range_span = 'pass' THEN 4 ELSE 3 END ELSE 2 END END,
  CASE labels_target WHEN 'warn' THEN 1 WHEN 'pass' THEN CASE WHEN labels_timestamps <> 'pass' THEN 2 WHEN labels_balance = 'pass' THEN 4 ELSE 3 END ELSE 0 END,
  CASE labels_leakage WHEN 'deferred' THEN 1 WHEN 'fail' THEN 0 WHEN 'pass' THEN 4 ELSE 3 END,
  CASE WHEN len(list_filter(feats, lambda x: x IN ('warn', 'fail'))) >= 2 THEN 0 WHEN len(list_filter(feats, lambda x: x IN ('warn', 'fail'))) = 1 OR features_numeric = 'fail' THEN 1 WHEN features_numeric = 'warn' THEN 2 WHEN features_numeric = 'pass' AND features_near_constant = 'pass' AND features_infinites = 'pass' THEN 4 ELSE 3 END,
  CASE len(list_filter(stats, lambda x: x IN ('warn', 'fail'))) WHEN 0 THEN CASE WHEN len(list_filter(stats, lambda x: x = 'pass')) = 3 THEN 4 ELSE 3 END WHEN 1 THEN 2 ELSE 1 END,
  CASE WHEN temporal_present = 'fail' THEN 0 WHEN temporal_ordering = 'warn' THEN 1 WHEN temporal_granularity = 'warn' THEN 2 WHEN temporal_present = 'pass' AND temporal_ordering = 'pass' AND temporal_granularity = 'pass' THEN 4 ELSE 3 END,
  CASE quality_rowcount WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 WHEN 'pass' THEN CASE WHEN n >= 10000 THEN 4 WHEN n >= 5000 THEN 3 ELSE 2 END ELSE 2 END,
  CASE WHEN line = 3 AND ops_cadence = 'pass' THEN 4 ELSE line END,
  CASE WHEN texts = 0 THEN 3 WHEN 'warn' IN (features_type_mismatch, features_missingness_pattern) THEN 1 ELSE 2 END]) AS INTEGER) AS level FROM a)"""
EVIDENCE_ROWS = ", ".join(f"('{c}', '{r}', {k})" for c, rules in cp.EVIDENCE.items() for k, r in enumerate(rules))


def levels(spark, sf_dir):
    found = facts(spark, sf_dir)
    return cp.capability_levels(rl.checks(found), found, dictionary(observed(spark, sf_dir, tuple(ASSESSED))))


@R.add("R20_capabilities", LEVELS + f""", ev(capability, rule_id, place) AS (VALUES {EVIDENCE_ROWS}), ids AS (SELECT table_name, capability, string_agg(substr(sha1(table_name || '|' || rule_id || '|'), 1, 12), ',' ORDER BY place) AS evidence FROM checks JOIN ev USING (rule_id) JOIN facts USING (table_name) WHERE capability <> 'TXT' OR texts > 0 GROUP BY table_name, capability)
SELECT table_name, capability, level, coalesce(evidence, '') AS evidence FROM levels LEFT JOIN ids USING (table_name, capability)""")  # fmt: skip
def capability_levels(spark, sf_dir):
    return levels(spark, sf_dir).withColumn("evidence", F.array_join("evidence", ","))


FLOOR_ROWS = ", ".join(f"('{a}', '{c}', {n})" for a, (floors, _) in vd.FLOORS.items() for c, n in floors.items())
GATE_ROWS = ", ".join(f"('{a}', '{g}')" for a, (_, gates) in vd.FLOORS.items() for g in gates)
REQUIRED = f"{LEVELS}, f(archetype, capability, floor) AS (VALUES {FLOOR_ROWS}), g(archetype, rule_id) AS (VALUES {GATE_ROWS})"


@R.add("R22_archetype_floors", REQUIRED + " SELECT table_name, archetype, capability, floor, level, level >= floor AS met FROM levels JOIN f USING (capability)")
def archetype_floors(spark, sf_dir):
    """The floor of every archetype against each table's level."""
    found = levels(spark, sf_dir)
    return found.join(F.broadcast(vd.floors(spark)), "capability").select("table_name", "archetype", "capability", "floor", "level", (F.col("level") >= F.col("floor")).alias("met"))


@R.add("R21_purpose_verdict", REQUIRED + """, per AS (SELECT table_name, archetype, count(*) AS required, count(*) FILTER (level = 0) AS zeros, count(*) FILTER (level < floor) AS gaps FROM levels JOIN f USING (capability) GROUP BY ALL),
shut AS (SELECT DISTINCT table_name, archetype FROM checks JOIN g USING (rule_id) WHERE status IN ('fail', 'deferred'))
SELECT table_name, archetype, CASE WHEN zeros > required / 2 THEN 'Purpose Mismatch' WHEN shut.archetype IS NOT NULL THEN 'At Risk' WHEN gaps > 0 THEN 'Conditional' ELSE 'Ready' END AS verdict, gaps FROM per LEFT JOIN shut USING (table_name, archetype)""")  # fmt: skip
def purpose_verdict(spark, sf_dir):
    """A gate is open where its rule fails or is deferred."""
    gated = rl.checks(facts(spark, sf_dir)).where("status IN ('fail', 'deferred')").select("table_name", "rule_id")
    return vd.verdicts(levels(spark, sf_dir), gated)


QUERIES, ORACLE = R.queries, R.oracle
