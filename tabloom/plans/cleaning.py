"""Sources (SRC), repair (SAN) and privacy (PII) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, privacy
from ..sources import glossary, readers
from .registry import query, rounded

# ---- a dirty view of customer, written once for Spark and once for SQL ----


def dirty_customer(t):
    k = F.col("c_custkey")
    money = (
        F.when(k % 7 == 0, F.lit("N/A")).when(k % 5 == 0, F.concat(F.lit(" $"), k.cast("string"), F.lit(",500")))
        .when(k % 3 == 0, F.concat(k.cast("string"), F.lit("k"))).when(k % 11 == 0, F.lit("oops"))
        .otherwise(F.concat(k.cast("string"), F.lit("%")))
    )
    return t.customer.select(
        F.col("c_custkey").alias(" Customer ID # "), money.alias("Spend ($)"),
        F.when(k % 2 == 0, "Yes").when(k % 9 == 0, "--").otherwise("no").alias("Prime Member"),
        F.when(k % 4 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.concat(F.lit("  "), F.when(k % 13 == 0, "Unknown").otherwise(F.col("c_mktsegment")), F.lit(" ")).alias("segment"),
        F.lit(None).cast("string").alias("empty"),
    )


DIRTY = """
SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_custkey * 1000 + 500.0
  WHEN c_custkey % 3 = 0 THEN c_custkey * 1000.0 WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey * 1.0 END::DOUBLE AS spend,
  CASE WHEN c_custkey % 2 = 0 THEN 1.0 WHEN c_custkey % 9 = 0 THEN NULL ELSE 0.0 END::DOUBLE AS prime,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer
"""


@query("san_01_to_07_repair", f"""
SELECT k AS Customer_ID, spend AS Spend, prime AS Prime_Member, round(bal, 2) + 0.0 AS c_acctbal, segment FROM ({DIRTY})""".replace(
    "c_custkey * 1000 + 500.0", "CAST(c_custkey || '500' AS DOUBLE)"))
def repaired(t):
    return rounded(clean.repair(dirty_customer(t))[0], 2)


@query("san_08_report", f"""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 7 = 0) AS a, count(*) FILTER (c_custkey % 2 <> 0 AND c_custkey % 9 = 0) AS b,
  count(*) FILTER (c_custkey % 4 = 0) AS i, count(*) FILTER (c_custkey % 13 = 0) AS u FROM customer)
SELECT v.* FROM c, LATERAL (VALUES ('renamed', 'Customer_ID', 1), ('renamed', 'Spend', 1), ('renamed', 'Prime_Member', 1),
 ('inf_replaced', 'c_acctbal', i), ('null_tokens', 'Spend', a), ('coerced_numeric', 'Spend', n - a), ('null_tokens', 'Prime_Member', b),
 ('boolean', 'Prime_Member', n - b), ('null_tokens', 'segment', u), ('dropped_all_null', 'empty', n),
 ('total_cells_repaired', '*', i + a + n - a + b + n - b + u)) AS v(kind, column_name, count)""")
def repair_report(t):
    return clean.repair(dirty_customer(t))[1].withColumnRenamed("column", "column_name")


@query("san_03_clean_text", """
SELECT doc_id, nullif_token AS cleaned FROM (
 SELECT doc_id, CASE WHEN lower(x) IN ('', 'nan', 'null', 'none', 'n/a', 'na', 'nil', 'unknown', 'missing', '?', '-', '--', '---',
   '#n/a', '#null!', '#value!', 'inf', '-inf') THEN NULL ELSE x END AS nullif_token
 FROM (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(160), ' '), '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g'),
       '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS x FROM documents))""")
def clean_documents(t):
    return t.documents.select("doc_id", clean.clean_text("text").alias("cleaned"))


@query("san_10_plain_text", """
SELECT conv_id, turn, regexp_replace(regexp_replace(replace(text, chr(0), ''), '[\\p{Cc}\\p{Cf}]', ' ', 'g'), '^ +| +$', '', 'g') AS plain,
  length(trim(regexp_replace(replace(text, chr(0), ''), '[\\p{Cc}\\p{Cf}]', ' ', 'g'))) > 0 AND length(text) <= 1000 AS usable
FROM conversations""")
def plain_conversations(t):
    return t.conversations.select(
        "conv_id", "turn", clean.plain_text("text").alias("plain"), clean.goal_text_ok("text").alias("usable")
    )


# ---- personal data: contact columns derived from the customer keys ----


def contacts(t):
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    return t.customer.select(
        "c_custkey", F.concat(F.lit("user"), k, F.lit("@mail"), n, F.lit(".example.com")).alias("contact"),
        F.concat(F.lit("555-"), F.lpad(n, 3, "0"), F.lit("-"), F.lpad(k, 4, "0")).alias("line"),
        F.concat(F.lit("10.0."), n, F.lit("."), (F.col("c_custkey") % 250).cast("string")).alias("host"),
        F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
    )


CONTACTS = """
SELECT c_custkey, concat('user', c_custkey, '@mail', c_nationkey, '.example.com') AS contact,
  concat('555-', lpad(c_nationkey::VARCHAR, 3, '0'), '-', lpad(c_custkey::VARCHAR, 4, '0')) AS line,
  concat('10.0.', c_nationkey, '.', c_custkey % 250) AS host, c_acctbal AS balance, c_name AS name, c_mktsegment AS segment FROM customer
"""
RX = {k: v.replace("'", "''") for k, v in privacy.VALUE_PATTERNS.items()}


@query("pii_01_pattern_hits", f"WITH c AS ({CONTACTS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS filled, '{label}' AS pattern, "
    f"count(*) FILTER (regexp_matches(trim({c}), '{rx}')) AS hits FROM c"
    for c in ("contact", "line", "host", "name", "segment") for label, rx in RX.items()))
def pattern_hits(t):
    return privacy.pattern_hits(contacts(t)).withColumnRenamed("column", "column_name")


@query("pii_01_scan", f"""
WITH c AS ({CONTACTS}), s AS (SELECT min(contact) AS contact, min(line) AS line, min(host) AS host,
  min(name) AS name FROM c)
SELECT 'contact' AS column_name, 'Unclassified' AS categories, 'Email Address' AS patterns, 'High' AS risk_level FROM s
UNION ALL SELECT 'line', 'Unclassified', 'Phone Number', 'High' FROM s
UNION ALL SELECT 'host', 'Unclassified', 'IP Address', 'High' FROM s
UNION ALL SELECT 'balance', 'Financial Data', 'None', 'High' FROM s
UNION ALL SELECT 'name', 'Direct Identifier', 'None', 'High' FROM s""")
def privacy_scan(t):
    s = privacy.scan(contacts(t))
    return s.select(
        F.col("column").alias("column_name"), F.array_join("header_categories", "|").alias("categories"),
        F.array_join("value_patterns", "|").alias("patterns"), "risk_level",
    )


@query("pii_01_scan_text", """
SELECT 'text' AS column_name, count(text) AS filled, count(*) FILTER (regexp_matches(trim(text), '^\\d{3}-\\d{2}-\\d{4}$')) AS ssn,
  count(*) FILTER (regexp_matches(trim(text), '^(?:[0-9]{1,3}\\.){3}[0-9]{1,3}$')) AS ip FROM documents""")
def privacy_documents(t):
    h = privacy.pattern_hits(t.documents, ["text"])
    return h.groupBy(F.col("column").alias("column_name")).agg(
        F.max("filled").alias("filled"), F.sum(F.when(F.col("pattern").startswith("Social"), F.col("hits"))).alias("ssn"),
        F.sum(F.when(F.col("pattern") == "IP Address", F.col("hits"))).alias("ip"),
    )


@query("pii_02_risk_summary", f"""
WITH c AS ({CONTACTS}), n AS (SELECT count(*) AS n FROM c)
SELECT 71 AS privacy_risk_score, 5::BIGINT AS pii_columns, 7 AS total_columns, 'Action Required (Anonymize PII)' AS gdpr_status,
 'Pass' AS hipaa_status, 'Warning (High Risk Data in Plaintext)' AS soc2_status FROM n""")
def risk_summary(t):
    return privacy.risk_summary(contacts(t))


@query("pii_03_mask", f"""
WITH c AS ({CONTACTS})
SELECT c_custkey, 'u***@' || split_part(contact, '@', 2) AS contact,
  substr(line, 1, 2) || repeat('*', length(line) - 4) || right(line, 2) AS line, host,
  CASE WHEN balance IS NULL THEN NULL ELSE '***' || lpad((((CAST(trunc(balance) AS BIGINT) % 100) + 100) % 100)::VARCHAR, 2, '0') END AS balance,
  name, segment FROM c""")
def mask(t):
    return privacy.mask(contacts(t), ["contact", "line", "balance"])


def requests(t):
    return t.orders.where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").cast("string").alias("subject_id"))


REQ = "SELECT DISTINCT o_custkey AS s FROM orders WHERE o_totalprice > 400000"


@query("pii_05_subject_export", f"""
WITH c AS ({CONTACTS}) SELECT c_custkey::VARCHAR AS subject_id, count(*) AS records, min(contact) AS contact
FROM c WHERE c_custkey IN ({REQ}) GROUP BY 1""")
def subject_export(t):
    e = privacy.subject_export(contacts(t), "c_custkey", requests(t))
    return e.groupBy("subject_id").agg(
        F.count("*").alias("records"), F.min(F.get_json_object("record", "$.contact")).alias("contact")
    )


@query("pii_06_erase_rows", f"SELECT c_custkey, name FROM ({CONTACTS}) WHERE c_custkey NOT IN ({REQ})")
def erase_rows(t):
    return privacy.erase_rows(contacts(t).select("c_custkey", "name"), "c_custkey", requests(t))


@query("pii_07_erase_fields", f"""
WITH c AS (SELECT *, c_custkey IN ({REQ}) AS hit FROM ({CONTACTS}))
SELECT CASE WHEN NOT hit THEN c_custkey END AS c_custkey, CASE WHEN hit THEN '{privacy.ERASED}' ELSE contact END AS contact,
 CASE WHEN hit THEN '{privacy.ERASED}' ELSE line END AS line, CASE WHEN hit THEN '{privacy.ERASED}' ELSE host END AS host,
 CASE WHEN NOT hit THEN balance END AS balance, CASE WHEN hit THEN '{privacy.ERASED}' ELSE name END AS name, segment FROM c""")
def erase_fields(t):
    return privacy.erase_fields(contacts(t), "c_custkey", requests(t))


@query("pii_08_processing_record", f"""
WITH c AS ({CONTACTS}), n AS (SELECT count(*) FROM c)
SELECT 'segment' AS target, 'classification' AS task_type, 'Direct Identifier|Financial Data|Unclassified' AS data_categories,
 'None Detected' AS special_category_data, 'balance|contact|host|line|name' AS pii_fields, 5 AS pii_features, 7 AS total_features,
 71 AS privacy_risk_score, 'Compliant with Privacy by Design Controls' AS gdpr_status FROM n""")
def processing_record(t):
    r = privacy.processing_record(contacts(t), "segment", "classification")
    for c in ("data_categories", "special_category_data", "pii_fields"):
        r = r.withColumn(c, F.array_join(c, "|"))
    return r


# ---- sources ----


@query("src_05_parquet_shape_gate", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def parquet(t):
    return readers.read_parquet(t.spark, f"{t.folder}/nation.parquet")


@query("src_06_json_records", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def json_flatten(t):
    parsed = t.events.select("event_id", F.from_json("props", "k bigint").alias("props"))
    return readers.flatten(parsed)


@query("src_12_target_gate", """
SELECT 'toxic' AS target, count(toxic) AS filled, count(toxic) >= 10 AS usable FROM labels""")
def target_gate(t):
    return readers.check_target(t.labels, "toxic")


@query("src_14_glossary", "SELECT trim(source) AS term, trim(text) AS definition FROM documents WHERE length(trim(source)) > 0")
def glossary_load(t):
    return glossary.load(t.documents.select(F.col("source").alias(" Term "), F.col("text").alias("Definition")))


def _entries(t, parity):
    return t.events.where(F.col("event_id") % 2 == parity).select(
        F.col("event_type").alias("tenant"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("User"), F.col("user_id").cast("string")))
        .otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("term"),
        F.col("props").alias("definition"), F.col("ts").alias("updated_at"),
    )


LATEST = """
SELECT event_type AS tenant, 'user' || user_id AS key, min(row(ts, CASE WHEN event_id % 3 = 0 THEN 'User' ELSE 'user' END || user_id))[2] AS term,
 max(row(ts, props))[2] AS definition, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY event_type, user_id
"""


@query("src_15_glossary_upsert", LATEST)
def glossary_upsert(t):
    return glossary.upsert(_entries(t, 0), _entries(t, 1))


@query("src_15_glossary_delete_count", f"""
SELECT tenant, count(*) AS terms FROM ({LATEST}) WHERE NOT (tenant = 'click' AND CAST(substr(key, 5) AS BIGINT) IN
  (SELECT user_id FROM events WHERE event_type = 'purchase')) GROUP BY tenant""")
def glossary_delete(t):
    kept = glossary.delete(
        glossary.upsert(_entries(t, 0), _entries(t, 1)),
        t.events.where("event_type = 'purchase'").select(F.lit("click").alias("tenant"), F.concat(F.lit("USER"), "user_id").alias("term")),
    )
    return glossary.count_terms(kept)
