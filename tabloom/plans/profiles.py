"""Profiles, roles, readiness (PRO) and contracts (DQ) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract, profile, query as q
from .registry import query, rounded, sql_rounded

KINDS = {
    "c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "string",
}
EVENT_KINDS = {
    "event_id": "int", "ts": "datetime", "user_id": "int", "event_type": "string", "value": "float", "props": "string",
}


def profile_sql(table: str, kinds: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS col, {i} AS position, '{k}' AS dtype, count(*) AS rows, count(*) - count({c}) AS null_count,
        round(100.0 * (count(*) - count({c})) / count(*), 1)::DOUBLE AS null_pct, count(DISTINCT {c}) AS unique_count,
        round(count(DISTINCT {c})::DOUBLE / count(*), 4) AS unique_ratio FROM {table}"""
        for i, (c, k) in enumerate(kinds.items())
    )


@query("pro_01_profile", f"""
WITH p AS ({profile_sql('customer', KINDS)}),
d AS ({" UNION ".join(f"SELECT '{c}' AS col, {c}::VARCHAR AS v FROM customer WHERE {c} IS NOT NULL" for c in KINDS if KINDS[c] != 'float')}),
s AS (SELECT col, string_agg(v, ', ' ORDER BY v) AS sample_values
      FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v) AS rn FROM d) WHERE rn <= 3 GROUP BY col)
SELECT col AS column_name, position, dtype, rows, null_count, null_pct, unique_count, unique_ratio, sample_values
FROM p LEFT JOIN s USING (col)""")
def profile_customer(t):
    # the two engines write fractions differently, so samples of such columns aren't compared
    p = profile.profile(t.customer).withColumn("sample_values", F.when(F.col("dtype") != "float", F.col("sample_values")))
    return p.withColumnRenamed("column", "column_name")


@query("pro_01_profile_documents", """
SELECT 'text' AS column_name, count(*) - count(text) AS null_count, count(DISTINCT text) AS unique_count FROM documents
UNION ALL SELECT 'source', count(*) - count(source), count(DISTINCT source) FROM documents
UNION ALL SELECT 'lang', count(*) - count(lang), count(DISTINCT lang) FROM documents
UNION ALL SELECT 'doc_id', count(*) - count(doc_id), count(DISTINCT doc_id) FROM documents
UNION ALL SELECT 'n_chars', count(*) - count(n_chars), count(DISTINCT n_chars) FROM documents""")
def profile_documents(t):
    return profile.profile(t.documents).select(F.col("column").alias("column_name"), "null_count", "unique_count")


ROLE_SQL = """
WITH p AS ({p}),
x AS (SELECT p.*, n.* EXCLUDE (c) FROM p JOIN (VALUES {names}) AS n(c, id_name, date_name, duration_name, target_name)
      ON p.col = n.c),
l AS ({lengths})
SELECT x.col AS column_name, CASE
  WHEN unique_count <= 1 THEN 'constant (useless)'
  WHEN unique_count = 2 AND target_name THEN 'target candidate'
  WHEN unique_count = 2 THEN 'binary flag'
  WHEN dtype <> 'float' AND id_name AND unique_ratio > 0.9 THEN 'identifier'
  WHEN dtype <> 'float' AND unique_ratio >= 0.99 AND rows >= 100 THEN 'identifier'
  WHEN dtype = 'float' AND unique_ratio > 0.8 THEN 'numeric feature'
  WHEN date_name OR dtype = 'datetime' OR (dtype = 'string' AND date_rate >= 1) THEN 'date / time'
  WHEN duration_name THEN 'duration / tenure'
  WHEN target_name THEN 'target candidate'
  WHEN dtype = 'string' AND unique_ratio > 0.5 THEN 'high-cardinality categorical'
  WHEN dtype = 'string' AND avg_length > 40 THEN 'free text'
  WHEN dtype = 'string' THEN 'categorical feature'
  WHEN dtype IN ('int', 'float') THEN 'numeric feature'
  ELSE 'categorical feature' END AS role
FROM x LEFT JOIN l ON x.col = l.col
"""


def _names(kinds):
    from ..functions.columns import name_tokens

    out = []
    for c in kinds:
        tk = name_tokens(c)
        flags = [bool(tk & s) for s in (profile.ID_TOKENS, profile.DATE_TOKENS, profile.DURATION_TOKENS, profile.TARGET_TOKENS)]
        out.append(f"('{c}', {', '.join(str(f).lower() for f in flags)})")
    return ", ".join(out)


def _lengths(table, kinds):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, avg(length({c})) AS avg_length, "
        f"avg(CASE WHEN {c} IS NOT NULL THEN (TRY_CAST({c} AS TIMESTAMP) IS NOT NULL)::INT END) AS date_rate FROM {table}"
        for c, k in kinds.items() if k == "string"
    )


@query("pro_02_roles", ROLE_SQL.format(
    p=profile_sql("events", EVENT_KINDS), names=_names(EVENT_KINDS), lengths=_lengths("events", EVENT_KINDS)))
def roles_events(t):
    return profile.roles(t.events).select(F.col("column").alias("column_name"), "role")


@query("pro_03_target_task", """
SELECT 'o_orderstatus' AS target, 'classification' AS task_type, count(DISTINCT o_orderstatus) AS unique_count,
       round(count(DISTINCT o_orderstatus)::DOUBLE / count(o_orderstatus), 8) + 0.0 AS unique_ratio,
       count(DISTINCT o_orderstatus) AS n_classes FROM orders
UNION ALL
SELECT 'o_custkey', CASE WHEN count(DISTINCT o_custkey) <= 20 THEN 'classification'
         WHEN count(DISTINCT o_custkey)::DOUBLE / count(o_custkey) > 0.05 THEN 'regression' ELSE 'classification' END,
       count(DISTINCT o_custkey), round(count(DISTINCT o_custkey)::DOUBLE / count(o_custkey), 8) + 0.0,
       CASE WHEN count(DISTINCT o_custkey)::DOUBLE / count(o_custkey) > 0.05 AND count(DISTINCT o_custkey) > 20
            THEN NULL ELSE count(DISTINCT o_custkey) END FROM orders
UNION ALL
SELECT 'o_totalprice', 'regression', count(DISTINCT o_totalprice),
       round(count(DISTINCT o_totalprice)::DOUBLE / count(o_totalprice), 8) + 0.0, NULL FROM orders""")
def target_task(t):
    out = None
    for c in ("o_orderstatus", "o_custkey", "o_totalprice"):
        part = profile.target_task(t.orders, c)
        out = part if out is None else out.unionByName(part)
    return rounded(out, 8)


@query("pro_04_readiness", f"""
WITH r AS ({ROLE_SQL.format(p=profile_sql('customer', KINDS), names=_names(KINDS), lengths=_lengths('customer', KINDS))}),
p AS ({profile_sql('customer', KINDS)}),
s AS (SELECT max(rows) AS rows,
  count(*) FILTER (col <> 'c_mktsegment' AND role IN ('numeric feature', 'duration / tenure', 'binary flag', 'categorical feature')) AS useful_features,
  count(*) FILTER (col <> 'c_mktsegment' AND role IN ('identifier', 'high-cardinality categorical', 'constant (useless)', 'date / time')) AS leakage_risk_features,
  count(*) FILTER (col <> 'c_mktsegment' AND null_pct > 50) AS mostly_null,
  max(null_pct) FILTER (col = 'c_mktsegment') AS target_null_pct FROM r JOIN p ON r.column_name = p.col),
z AS (SELECT *, CAST(greatest(0, least(100, 100 - 5 * mostly_null - CASE WHEN rows < 100 THEN 20 WHEN rows < 500 THEN 10 ELSE 0 END
  - CASE WHEN target_null_pct > 10 THEN 15 ELSE 0 END
  - CASE WHEN useful_features = 0 THEN 20 WHEN useful_features < 3 THEN 5 ELSE 0 END)) AS INTEGER) AS score FROM s)
SELECT *, CASE WHEN score >= 75 THEN 'Ready' WHEN score >= 45 THEN 'Partially Ready' ELSE 'Not Ready' END AS verdict FROM z""")
def readiness(t):
    return profile.readiness(t.customer, "c_mktsegment")


@query("pro_05_readiness_audit", f"""
WITH p AS ({profile_sql('orders', {'o_orderkey': 'int', 'o_custkey': 'int', 'o_orderstatus': 'string', 'o_totalprice': 'float', 'o_orderdate': 'datetime', 'o_orderpriority': 'string'})}),
c AS (SELECT (abs(corr(o_orderkey, o_custkey)) > .85)::INT + (abs(corr(o_orderkey, o_totalprice)) > .85)::INT
             + (abs(corr(o_custkey, o_totalprice)) > .85)::INT AS collinear_pairs FROM orders),
s AS (SELECT max(rows) AS rows, 100.0 * sum(null_count) / (max(rows) * count(*)) AS null_pct,
   count(*) FILTER (dtype = 'string' AND unique_count > 50 AND unique_count / rows > 0.4) AS high_cardinality_columns FROM p),
z AS (SELECT rows, round(null_pct, 6)::DOUBLE AS null_pct, high_cardinality_columns, collinear_pairs::BIGINT AS collinear_pairs,
   CAST(greatest(40, 100 - CASE WHEN null_pct >= 10 THEN 20 ELSE 0 END - CASE WHEN rows < 100 THEN 25 ELSE 0 END
     - CASE WHEN high_cardinality_columns > 0 THEN 15 ELSE 0 END) AS INTEGER) AS score FROM s, c)
SELECT *, CASE WHEN score >= 85 THEN 'READY FOR ENTERPRISE PRODUCTION' WHEN score >= 70 THEN 'CONDITIONAL READINESS'
          ELSE 'REMEDIATION RECOMMENDED' END AS verdict FROM z""")
def readiness_audit(t):
    return rounded(profile.readiness_audit(t.orders))


@query("pro_06_simple_roles", f"""
WITH p AS ({profile_sql('events', EVENT_KINDS)}), l AS ({_lengths('events', EVENT_KINDS)})
SELECT p.col AS column_name, dtype, null_count, round(100.0 * null_count / rows, 2)::DOUBLE AS null_pct, unique_count,
  CASE WHEN dtype IN ('int', 'float', 'bool') THEN 'numeric'
       WHEN contains(lower(p.col), 'date') OR contains(lower(p.col), 'time') OR dtype = 'datetime' THEN 'datetime'
       WHEN contains(lower(p.col), 'id') OR contains(lower(p.col), 'key') THEN 'id_entity'
       WHEN unique_count < 12 THEN 'categorical_low' WHEN avg_length > 30 THEN 'text' ELSE 'categorical_high' END AS role
FROM p LEFT JOIN l ON p.col = l.col""")
def simple_roles(t):
    return profile.simple_roles(t.events).withColumnRenamed("column", "column_name")


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]


@query("pro_07_column_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) + 0.0 AS mean, "
    f"round(stddev_samp({c}), 4) + 0.0 AS std, round(min({c}), 4)::DOUBLE AS min, "
    f"round(quantile_cont({c}::DOUBLE, .25), 4) + 0.0 AS q25, round(quantile_cont({c}::DOUBLE, .5), 4) + 0.0 AS q50, "
    f"round(quantile_cont({c}::DOUBLE, .75), 4) + 0.0 AS q75, round(max({c}), 4)::DOUBLE AS max FROM lineitem" for c in LI_NUM))
def column_summary(t):
    return rounded(q.column_summary(t.lineitem, LI_NUM).withColumnRenamed("column", "column_name"), 4)


@query("pro_08_top_correlations", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 8) + 0.0 AS r, count(*) AS n FROM lineitem"
    for i, a in enumerate(LI_NUM) for b in LI_NUM[i + 1:]) + ") ORDER BY abs(r) DESC LIMIT 6")
def top_correlations(t):
    return rounded(profile.top_correlations(t.lineitem, LI_NUM, 6), 8)


@query("pro_09_capabilities", """
SELECT count(*) AS rows, false AS has_dates, avg(length(text)) > 25 OR avg(length(lang)) > 25 OR avg(length(source)) > 25
  AS has_text, true AS has_entities FROM documents""")
def capabilities(t):
    return profile.capabilities(t.documents)


@query("pro_10_fingerprint")
def fingerprint(t):
    return profile.fingerprint(t.orders)


@query("dq_01_contract", """
WITH s AS (SELECT count(*) AS n, min(c_custkey)::DOUBLE AS k0, max(c_custkey)::DOUBLE AS k1, min(c_nationkey)::DOUBLE AS n0,
  max(c_nationkey)::DOUBLE AS n1, min(c_acctbal) AS a0, max(c_acctbal) AS a1, count(DISTINCT c_name) AS dn FROM customer)
SELECT r.rule_id, r.rule, r.col AS column_name, r.mn AS min_value, r.mx AS max_value, r.mostly FROM s, (VALUES
  (0, 'columns_match_set', NULL, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE), (1, 'column_exists', 'c_mktsegment', NULL, NULL, NULL),
  (2, 'not_null', 'c_mktsegment', NULL, NULL, 1.0), (3, 'not_null', 'c_custkey', NULL, NULL, 1.0),
  (5, 'of_type', 'c_custkey', NULL, NULL, NULL), (6, 'not_null', 'c_name', NULL, NULL, 1.0),
  (7, 'of_type', 'c_name', NULL, NULL, NULL), (8, 'not_null', 'c_nationkey', NULL, NULL, 1.0),
  (10, 'of_type', 'c_nationkey', NULL, NULL, NULL), (11, 'not_null', 'c_acctbal', NULL, NULL, 1.0),
  (13, 'of_type', 'c_acctbal', NULL, NULL, NULL)) AS r(rule_id, rule, col, mn, mx, mostly)
UNION ALL SELECT 4, 'between', 'c_custkey', k0, k1, NULL FROM s UNION ALL SELECT 9, 'between', 'c_nationkey', n0, n1, NULL FROM s
UNION ALL SELECT 12, 'between', 'c_acctbal', a0, a1, NULL FROM s""")
def contract_rules(t):
    c = contract.learn(t.customer, "c_mktsegment")
    return c.select("rule_id", "rule", F.col("column").alias("column_name"), "min_value", "max_value", "mostly")


def _half_checks(t):
    cut = F.expr("pmod(o_orderkey, 2)")
    learned = contract.learn(t.orders.where(cut == 0), "o_orderstatus")
    return contract.check(t.orders.where(cut == 1), learned)


@query("dq_02_to_07_contract_check", """
WITH a AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1),
la AS (SELECT min(o_orderkey) AS k0, max(o_orderkey) AS k1, min(o_custkey) AS c0, max(o_custkey) AS c1,
              min(o_totalprice) AS p0, max(o_totalprice) AS p1 FROM a),
lb AS (SELECT min(o_orderkey) AS k0, max(o_orderkey) AS k1, min(o_custkey) AS c0, max(o_custkey) AS c1,
              min(o_totalprice) AS p0, max(o_totalprice) AS p1 FROM b),
x AS (SELECT la.k0 - 1e-4 <= lb.k0 AND lb.k1 <= la.k1 + 1e-4 AS ok_k, la.c0 - 1e-4 <= lb.c0 AND lb.c1 <= la.c1 + 1e-4 AS ok_c,
             la.p0 - 1e-4 <= lb.p0 AND lb.p1 <= la.p1 + 1e-4 AS ok_p FROM la, lb),
s AS (SELECT NOT EXISTS (SELECT 1 FROM b WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM a)) AS ok_s)
SELECT v.* FROM x, s, LATERAL (VALUES (0, 'columns_match_set', 'table', true), (1, 'column_exists', 'o_orderstatus', true),
 (2, 'not_null', 'o_orderstatus', true), (3, 'not_null', 'o_orderkey', true), (4, 'between', 'o_orderkey', ok_k),
 (5, 'of_type', 'o_orderkey', true), (6, 'not_null', 'o_custkey', true), (7, 'between', 'o_custkey', ok_c),
 (8, 'of_type', 'o_custkey', true), (9, 'not_null', 'o_totalprice', true), (10, 'between', 'o_totalprice', ok_p),
 (11, 'of_type', 'o_totalprice', true), (12, 'not_null', 'o_orderdate', true), (13, 'not_null', 'o_orderpriority', true),
 (14, 'in_set', 'o_orderpriority', ok_s), (15, 'of_type', 'o_orderpriority', true)) AS v(rule_id, rule, column_name, success)""")
def contract_check(t):
    return _half_checks(t).select("rule_id", "rule", F.col("column").alias("column_name"), "success")


@query("dq_06_unexpected_values", """
SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN
  (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) GROUP BY 1 ORDER BY n DESC, value LIMIT 5""")
def unexpected_values(t):
    allowed = q.value_counts(t.events, "event_type", 2)
    return contract.unexpected_values(t.events, "event_type", allowed)


@query("dq_08_summary", """
WITH a AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1),
f AS (SELECT (min(b.o_orderkey) < (SELECT min(o_orderkey) FROM a) - 1e-4 OR max(b.o_orderkey) > (SELECT max(o_orderkey) FROM a) + 1e-4)::INT
  + (min(b.o_custkey) < (SELECT min(o_custkey) FROM a) - 1e-4 OR max(b.o_custkey) > (SELECT max(o_custkey) FROM a) + 1e-4)::INT
  + (min(b.o_totalprice) < (SELECT min(o_totalprice) FROM a) - 1e-4 OR max(b.o_totalprice) > (SELECT max(o_totalprice) FROM a) + 1e-4)::INT
  + (count(*) FILTER (b.o_orderpriority NOT IN (SELECT o_orderpriority FROM a)) > 0)::INT AS bad FROM b)
SELECT 16::BIGINT AS n_rules, (16 - bad)::BIGINT AS n_passed, bad::BIGINT AS n_failed,
       round((16 - bad) / 16.0, 4)::DOUBLE AS pass_rate, bad = 0 AS success FROM f""")
def contract_summary(t):
    return contract.summary(_half_checks(t))
