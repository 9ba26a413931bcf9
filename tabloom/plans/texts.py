"""Matching (PRO-11..14, QRY-11), retrieval (QRY-17..19) and text features (TXT) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match, retrieval, text
from .registry import query, rounded, sql_rounded


def any_sql(c: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words) + ")"


def hits_sql(c: str, words) -> str:
    return "(" + " + ".join("contains({}, '{}')::INT".format(c, w.replace("'", "''")) for w in words) + ")"


def words_of(t):
    """Distinct lower-case words of the conversations."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), F.lit(0))
    return t.conversations.select(F.explode(w).alias("term")).distinct()


MATCH_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _match_sql() -> str:
    parts = []
    for i, c in enumerate(MATCH_COLUMNS):
        n = match.snake(c)
        toks = [n, *n.split("_")]
        fuzzy = "greatest(" + ", ".join(f"1 - levenshtein(n, '{x}') / greatest(length(n), {len(x)}, 1)::DOUBLE" for x in toks) + ")"
        first = " ".join(
            f"WHEN n IN ({', '.join(repr(match.snake(w)) for w in [*words, k])}) THEN '{k}'" for k, words in match.SYNONYMS.items()
        )
        mine = ", ".join(f"'{k}'" for k in match._clusters(c)) or "''"
        vals = (f"length(term) >= 3 AND EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(trim({c}::VARCHAR)) AS v FROM part) WHERE contains(v, term)) "
                f"AND (SELECT count(DISTINCT {c}) FROM part) <= 50")
        parts.append(f"""SELECT term, '{c}' AS column_name, {i} AS pos, CASE WHEN term = '{c}' THEN 1.0 WHEN n = '{n}' THEN 0.98
 WHEN contains('{n}', n) OR contains(n, '{n}') THEN 0.90 WHEN (CASE {first} END) IN ({mine}) THEN 0.88 WHEN {vals} THEN 0.85
 WHEN {fuzzy} >= 0.6 THEN {fuzzy} ELSE 0 END::DOUBLE AS score FROM w""")
    return f"""WITH w AS (SELECT DISTINCT term, term AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM conversations)),
s AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, pos) AS rn FROM s WHERE score > 0)
SELECT term, column_name, round(score, 8) + 0.0 AS score FROM r WHERE rn = 1"""


@query("pro_11_match_columns", _match_sql())
def match_columns(t):
    m = match.match_columns(words_of(t), match.catalogue({"part": t.part}))
    return rounded(m.select("term", F.col("column").alias("column_name"), "score"), 8)


@query("pro_12_rank_targets")
def rank_targets(t):
    goals = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("goal_id"), "text")
    return match.rank_targets(goals, "goal_id", "text", t.orders).withColumnRenamed("column", "column_name")


@query("pro_13_goal_task", f"""
WITH h AS (SELECT doc_id, {hits_sql('lower(text)', match.CLASSIFICATION_WORDS)} AS a, {hits_sql('lower(text)', match.REGRESSION_WORDS)} AS b FROM documents)
SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN 'unknown' WHEN b > a THEN 'regression' ELSE 'classification' END AS task,
 round(CASE WHEN a = 0 AND b = 0 THEN 0.0 WHEN a = b THEN 0.5 ELSE least(0.5 + 0.1 * greatest(a, b), 0.9) END, 4)::DOUBLE AS confidence FROM h""")
def goal_task(t):
    task, conf = match.goal_task(F.col("text"))
    return rounded(t.documents.select("doc_id", task.alias("task"), conf.alias("confidence")), 4)


@query("pro_14_domain")
def domain(t):
    return match.infer_domain(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_quantity", "l_discount", "l_tax", "p_brand", "p_retailprice"))


def _named_sql(cols) -> str:
    parts = []
    for c in cols:
        words = ", ".join(f"'{w}'" for w in [c])
        parts.append(f"(contains(q, '{c}') OR contains(q, '{c.replace('_', ' ')}') OR list_has_any(w, [{words}]))")
    return "(" + " OR ".join(parts) + ")"


NUMS, CATS = ["quality", "value", "score", "amount"], ["source", "language", "type", "status"]


@query("qry_11_question_intent", f"""
WITH d AS (SELECT conv_id, turn, lower(trim(text)) AS q, regexp_extract_all(lower(text), '[a-zA-Z0-9_]+') AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN {any_sql('q', match.OUTLIER_WORDS)} THEN 'outlier_investigation' WHEN {any_sql('q', match.BIVARIATE_WORDS)} THEN 'bivariate_relationship'
 WHEN {any_sql('q', match.TOP_WORDS)} AND ({_named_sql(CATS)} OR {any_sql('q', match.CATEGORY_WORDS)}) THEN 'top_k_contributors'
 WHEN {any_sql('q', match.SEGMENT_WORDS)} AND {_named_sql(CATS)} AND {_named_sql(NUMS)} THEN 'segment_comparison' WHEN {any_sql('q', match.GROUP_WORDS)} THEN 'segment_comparison'
 WHEN {any_sql('q', match.DISTRIBUTION_WORDS)} OR {_named_sql(CATS)} OR {_named_sql(NUMS)} THEN 'distribution_profile' ELSE 'general_profile' END AS intent FROM d""")
def question_intent(t):
    return t.conversations.select("conv_id", "turn", match.question_intent(F.col("text"), NUMS, CATS).alias("intent"))


@query("qry_17_vector_search", """
WITH q AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
 GROUP BY label, i) GROUP BY label),
s AS (SELECT q.label, vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q.v) AS score FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT label, vec_id, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def vector_search(t):
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    center = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    return rounded(retrieval.vector_search(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", center, "label", "v", 5), 6)


@query("qry_18_lexical_search", """
WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS d FROM documents),
q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark),
s AS (SELECT item_id, doc_id, len(list_intersect(d, q)) AS n, len(d) AS nd, len(q) AS nq FROM d, q),
r AS (SELECT item_id, doc_id, n / (nd + nq - n)::DOUBLE AS score FROM s WHERE n > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
SELECT item_id, doc_id, round(score, 8) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")
def lexical_search(t):
    return rounded(retrieval.lexical_search(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", 5), 8)


@query("qry_19_corpus")
def corpus(t):
    terms = t.part.select(F.col("p_brand").alias("term"), F.col("p_type").alias("definition")).groupBy("term").agg(F.min("definition").alias("definition"))
    return retrieval.corpus(t.orders, "o_orderstatus", terms)


# ---- text features ----


@query("txt_01_simple_text_columns", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(avg(len(regexp_split_to_array(trim({c}, ' \t\n\r\x0b\f'), '[\\t\\n\\x0B\\f\\r ]+'))), 6) + 0.0 AS avg_words,
 avg(len(regexp_split_to_array(trim({c}, ' \t\n\r\x0b\f'), '[\\t\\n\\x0B\\f\\r ]+'))) >= 3 AS is_text FROM documents WHERE length(trim({c}, ' \t\n\r\x0b\f')) > 0""" for c in ("text", "lang", "source")))
def simple_text(t):
    df = t.documents.where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) > 0)
    return rounded(text.simple_text_columns(df).withColumnRenamed("column", "column_name"), 6)


STRICT = " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count(v) AS rows, count(DISTINCT v) / greatest(count(v), 1)::DOUBLE AS unique_ratio,
 avg(len(regexp_extract_all(v, '{text.WORD}'))) AS avg_words, avg(length(v)) AS avg_length, var_pop(length(v)) AS length_variance,
 avg((TRY_CAST(v AS TIMESTAMP) IS NOT NULL)::INT) AS date_rate FROM (SELECT trim({c}) AS v FROM documents WHERE length(trim({c})) > 0)""" for c in ("text", "lang", "source"))


@query("txt_02_strict_text_columns", f"""
SELECT column_name, rows, round(unique_ratio, 6) + 0.0 AS unique_ratio, round(avg_words, 6) + 0.0 AS avg_words, round(avg_length, 6) + 0.0 AS avg_length,
 round(length_variance, 4) + 0.0 AS length_variance,
 rows >= 3 AND unique_ratio >= .3 AND avg_words >= 3 AND avg_length >= 12 AND length_variance >= 15 AND date_rate < .8 AS is_text FROM ({STRICT})""")
def strict_text(t):
    return rounded(text.strict_text_columns(t.documents).withColumnRenamed("column", "column_name"), 6, length_variance=4)


@query("txt_03_lexical_features", sql_rounded("""
SELECT doc_id, length(text) AS text_char_count, length(text)::DOUBLE / greatest(wc, 1) AS text_avg_word_len, wc AS text_word_count,
 len(regexp_extract_all(text, '\\p{Lu}'))::DOUBLE / greatest(length(text), 1) AS text_uppercase_ratio,
 len(regexp_extract_all(text, '[0-9]'))::DOUBLE / greatest(length(text), 1) AS text_digit_ratio,
 len(regexp_extract_all(text, '!')) AS text_exclamations, len(regexp_extract_all(text, '\\?')) AS text_questions
FROM (SELECT doc_id, coalesce(text, '') AS text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '')) AS wc FROM documents)""",
    "doc_id text_char_count::INT_AS_text_char_count text_word_count::INT_AS_text_word_count text_exclamations::INT_AS_text_exclamations text_questions::INT_AS_text_questions",
    8, "text_avg_word_len text_uppercase_ratio text_digit_ratio").replace("_AS_", " AS "))
def lexical(t):
    out = text.lexical_features(t.documents.select("doc_id", "text"), "text")
    return rounded(out.drop("text", "text_sentiment_score"), 8)


@query("txt_04_sentiment", f"""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents),
c AS (SELECT doc_id, len(list_intersect(w, {text.POSITIVE})) AS p, len(list_intersect(w, {text.NEGATIVE})) AS n FROM w)
SELECT doc_id, CASE WHEN p + n > 0 THEN round((p - n) / (p + n)::DOUBLE, 8) + 0.0 ELSE 0.0 END::DOUBLE AS sentiment FROM c""")
def sentiment(t):
    return rounded(t.documents.select("doc_id", text.sentiment(F.col("text")).alias("sentiment")), 8)


STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ("the", "a", "an", "and", "of", "to", "in", "is", "that", "for")) + "]"


@query("txt_05_tfidf", f"""
WITH w AS (SELECT conv_id || ':' || turn AS k, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: NOT list_contains({STOP}, x)) AS w FROM conversations),
g AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
c AS (SELECT k, term, count(*) AS tf FROM g GROUP BY 1, 2),
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM conversations)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 100),
x AS (SELECT k, term, (1 + ln(tf)) * idf AS x FROM c JOIN v USING (term))
SELECT k, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY k)), 8) + 0.0 AS weight FROM x""")
def tfidf(t):
    df = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    stop = ["the", "a", "an", "and", "of", "to", "in", "is", "that", "for"]
    return rounded(text.tfidf(df, "k", "text", 100, True, stop).weights.select("k", "term", "weight"), 8)


def talk(t):
    return t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("k"), "role", "text")


@query("txt_06_svd_embedding")
def svd(t):
    model = text.tfidf(talk(t), "k", "text", 5000)
    return text.embed(model, text.fit_svd(model, 8), "text_svd")


@query("txt_07_top_terms")
def top_terms(t):
    model = text.tfidf(talk(t), "k", "text", 5000)
    return text.top_terms(model, text.fit_svd(model, 4))


@query("txt_08_fuse")
def fuse(t):
    return text.fuse(talk(t), "k", ["text"], 4, 5000, drop_text=True)
