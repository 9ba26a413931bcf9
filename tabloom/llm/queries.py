"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import conversation, decontaminate, filter_audit, language, lattice, licences, mixing, page_text, quality, simhash, token_files, url_filter, warc
from tabloom.llm.common import stored
from tabloom.plans.registry import Tables

#: Tokenizer of the token files and the id that ends a document there.
TOKENIZER, END_ID = "word_bpe_49k.json", 2

#: Targets of the mixture: weights among siblings, share of all tokens to take, passes over a leaf at most, seed.
DOMAIN_WEIGHTS = {"web": 5.0, "books": 3.0, "code": 2.0}
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}
MIX_WEIGHTS = {(d,): x for d, x in DOMAIN_WEIGHTS.items()} | {(d, g): x for d in DOMAIN_WEIGHTS for g, x in LANG_WEIGHTS.items()}
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = 0.6, 2, 17

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return fn

    return add


@_query("op2_simhash")
def op2(t: Tables) -> DataFrame:
    return simhash.near_duplicates(t.documents)


@_query("op4_token_files")
def op4(t: Tables) -> DataFrame:
    import public_tokenizers

    return token_files.read_token_files(token_files.write_token_files(t.documents, public_tokenizers.path(TOKENIZER), END_ID))


_SPACE = r"[^\x20\x09-\x0D]"
_LEAST = " ".join(f"WHEN '{m}' THEN {x}" for m, x in quality.MEASURES.items())
_FENCES = "".join(f""",
f{depth} AS (
  SELECT {by} measure, max(total) AS n, {least_low} AS floor, {least_high} AS top FROM (
    SELECT *, CASE measure {_LEAST} END AS least FROM (
      SELECT {by} measure, max(total) AS total, min(bin) FILTER (upto * 100 >= total * 10) AS low,
             min(bin) FILTER (upto * 100 >= total * 50) AS mid, min(bin) FILTER (upto * 100 >= total * 90) AS high
      FROM (SELECT {by} measure, bin, sum(n) OVER (PARTITION BY {by} measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by} measure) AS total
            FROM (SELECT {by} measure, bin, sum(n) AS n FROM sketch GROUP BY {by} measure, bin))
      GROUP BY {by} measure)) GROUP BY {by} measure)""" for depth, by, least_low, least_high in [
    (d, b, f"max(low - {quality.SPREADS} * greatest(mid - low, least))", f"max(high + {quality.SPREADS} * greatest(high - mid, least))")
    for d, b in enumerate(("lang, source,", "lang,", ""))])
_PICK = "CASE WHEN f0.n >= {0} THEN f0.{1} WHEN f1.n >= {0} THEN f1.{1} ELSE f2.{1} END AS {1}"


@_query("op9_adaptive_quality", f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS ls FROM documents),
tri AS (
  SELECT rid, i, x, lead(x) OVER (PARTITION BY rid ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY rid ORDER BY i) AS z
  FROM (SELECT rid, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w)),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS times FROM tri WHERE z IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE times > 1) GROUP BY rid),
base AS (
  SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         word_chars * 1000 // greatest(n_words, 1) AS word_length, n_symbols * 1000 // greatest(n_words, 1) AS symbols_per_word,
         n_dup_lines * 1000 // greatest(n_words, 1) AS dup_lines_per_word, n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_share FROM base),
long AS (
  SELECT rid, lang, source, base_failed, unnest({list(quality.MEASURES)!r}) AS measure, unnest([{", ".join(quality.MEASURES)}]) AS v FROM judged),
sketch AS (
  SELECT lang, source, measure, v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0)) AS bin, count(*) AS n
  FROM long WHERE NOT base_failed GROUP BY ALL){_FENCES},
cut AS (
  SELECT f0.lang, f0.source, f0.measure, {_PICK.format(quality.MIN_GROUP, "floor")}, {_PICK.format(quality.MIN_GROUP, "top")}
  FROM f0 JOIN f1 ON f0.measure = f1.measure AND f0.lang IS NOT DISTINCT FROM f1.lang JOIN f2 ON f0.measure = f2.measure),
verdict AS (
  SELECT rid, bool_and(coalesce(v <= top AND (long.measure <> '{quality.TWO_SIDED}' OR v >= floor), TRUE)) AS inside
  FROM long LEFT JOIN cut ON long.lang IS NOT DISTINCT FROM cut.lang AND long.source IS NOT DISTINCT FROM cut.source AND long.measure = cut.measure GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept
FROM judged JOIN verdict USING (rid)""")
def op9(t: Tables) -> DataFrame:
    return quality.adaptive_filter(t.documents)


def source_domain(source: Column) -> Column:
    """The domain of a source; the tables have none, so it is drawn from a hash of the source's name."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)
    return F.when(digit < "6", "web").when(digit < "b", "books").otherwise("code")


def _mix_level(depth: int) -> str:
    """SQL that gives the nodes of one tree level their budgets."""
    path = ["domain", "lang", "source"][:depth]
    cols, parent = ", ".join(path), ", ".join(path[:-1])
    by = f"PARTITION BY {parent} " if parent else ""
    case = " ".join("WHEN " + " AND ".join(f"{p} = '{v}'" for p, v in zip(path, k)) + f" THEN {x}::DOUBLE" for k, x in MIX_WEIGHTS.items() if len(k) == depth)
    weight = f"CASE {case} ELSE 1.0::DOUBLE END" if case else "1.0::DOUBLE"
    given = "(SELECT floor(%s::DOUBLE * sum(tokens))::BIGINT FROM leaves)" % MIX_FRACTION if depth == 1 else "u.budget"
    up = "" if depth == 1 else f" JOIN level{depth - 1} u ON " + " AND ".join(f"k.{p} IS NOT DISTINCT FROM u.{p}" for p in path[:-1])
    return f""",
level{depth} AS (
  SELECT {cols}, CASE WHEN filled THEN room ELSE least(room, greatest(floor((given - room_full) * weight / nullif(weight_open, 0)), 0)) END::BIGINT AS budget FROM (
    SELECT *, coalesce(sum(room) FILTER (filled) OVER ({by}), 0)::BIGINT AS room_full, sum(weight) FILTER (NOT filled) OVER ({by}) AS weight_open FROM (
      SELECT *, room * (weights - weight_before) <= weight * (given - room_before) AS filled FROM (
        SELECT *, coalesce(sum(room) OVER ({by}ORDER BY room / weight, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room_before,
               coalesce(sum(weight) OVER ({by}ORDER BY room / weight, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before,
               sum(weight) OVER ({by}) AS weights
        FROM (SELECT {", ".join("k." + p for p in path)}, k.room, k.weight, {given} AS given
              FROM (SELECT {cols}, {weight} AS weight, (sum(tokens) * {MIX_EPOCHS})::BIGINT AS room FROM leaves GROUP BY {cols}) k{up})))))"""


@_query("op10_mixture", f"""
WITH docs AS (
  SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '6' THEN 'web' WHEN substr(md5(coalesce(source, '')), 1, 1) < 'b' THEN 'books' ELSE 'code' END AS domain,
         lang, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL){"".join(map(_mix_level, (1, 2, 3)))},
plan AS (
  SELECT l.*, CASE WHEN tokens > 0 THEN budget // nullif(tokens, 0) ELSE {MIX_EPOCHS} END AS whole, CASE WHEN tokens > 0 THEN budget % nullif(tokens, 0) ELSE 0 END AS rest
  FROM leaves l JOIN level3 b ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
placed AS (
  SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source
    ORDER BY md5(concat_ws('|', '{MIX_SEED}', whole::VARCHAR, coalesce(doc_id::VARCHAR, 'null'))), doc_id::VARCHAR, n_tokens ROWS UNBOUNDED PRECEDING) AS run
  FROM docs d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(whole))::INT AS epoch FROM placed WHERE whole > 0
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, whole::INT AS epoch FROM placed WHERE rest > 0 AND run <= rest""")
def op10(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "source", mixing.word_count(F.col("text")).alias("n_tokens"))
    mixed = mixing.mix(stored(docs, "token-counts"), F.col("n_tokens"), source_domain(F.col("source")), MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED)
    return mixed.select("row.doc_id", "domain", "lang", "source", "row.n_tokens", "epoch")


#: Where the dated list entries come from: (list, parent domain or host, first hex digits of the host's hash that
#: must lie below this, offset of the day digits, days after which the entry is removed, or none).
_ENTRY_RULES = [("abuse", "parent", "8", 2, 60), ("abuse", "host", "3", 4, None), ("adult", "host", "6", 6, 30), ("adult", "parent", "2", 8, 120)]
_FIRST_DAY = "2024-01-01"


def list_entries(hosts: DataFrame) -> DataFrame:
    """Dated entries drawn from the hosts of the table itself, by digits of their hash."""
    h = F.md5(F.col("host"))
    parent = F.when(F.size(F.split("host", r"\.")) > 3, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.col("host"))
    events = []
    for name, kind, below, at, days in _ENTRY_RULES:
        start = F.date_add(F.lit(_FIRST_DAY).cast("date"), F.conv(F.substring(h, at, 2), 16, 10).cast("int"))
        for day, action in [(start, "add")] + ([(F.date_add(start, days), "remove")] if days else []):
            event = F.struct(F.lit(name).alias("list"), (parent if kind == "parent" else F.col("host")).alias("pattern"), day.alias("day"), F.lit(action).alias("action"))
            events.append(F.when(F.substring(h, 1, 1) < below, event))
    return hosts.select(F.explode(F.array_compact(F.array(*events))).alias("e")).select("e.*")


def _entry_sql() -> str:
    parent = "CASE WHEN len(string_split(host, '.')) > 3 THEN regexp_replace(host, '^[^.]*\\.', '') ELSE host END"
    out = []
    for name, kind, below, at, days in _ENTRY_RULES:
        day = f"DATE '{_FIRST_DAY}' + ('0x' || substr(md5(host), {at}, 2))::INT"
        for shift, action in [(0, "add")] + ([(days, "remove")] if days else []):
            out.append(f"SELECT '{name}' AS list, {parent if kind == 'parent' else 'host'} AS pattern, ({day} + {shift})::DATE AS day, '{action}' AS action FROM hosts WHERE substr(md5(host), 1, 1) < '{below}'")
    return " UNION ALL ".join(out)


@_query("op7_url_filter", f"""
WITH raw AS (SELECT page_id, regexp_replace(regexp_extract(lower(coalesce(url, '')), '{url_filter.HOST_PATTERN}', 1), '\\.$', '') AS h,
                    DATE '{_FIRST_DAY}' + (page_id * 37 % 366)::INT AS day FROM pages),
seen AS (SELECT page_id, CASE WHEN length(h) <= {url_filter.MAX_HOST} THEN h ELSE '' END AS host, day::DATE AS day FROM raw),
hosts AS (SELECT DISTINCT host FROM seen WHERE host <> ''),
entries AS ({_entry_sql()}),
state AS (SELECT list, pattern, day, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) = 0 AS active FROM entries GROUP BY ALL),
turns AS (SELECT * FROM (SELECT *, lag(active, 1, FALSE) OVER (PARTITION BY list, pattern ORDER BY day) AS was FROM state) WHERE active <> was),
valid AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS valid_to FROM turns) WHERE active),
hit AS (SELECT DISTINCT s.host, s.day, v.list, v.pattern FROM seen s JOIN valid v
        ON (s.host = v.pattern OR ends_with(s.host, '.' || v.pattern)) AND v.day <= s.day AND (v.valid_to IS NULL OR s.day < v.valid_to) WHERE s.host <> ''),
verdict AS (SELECT host, day, count(*) AS n_active, array_to_string(list_sort(list_distinct(array_agg(list))), ',') AS lists,
                   (array_agg(pattern ORDER BY length(pattern) DESC, pattern))[1] AS pattern FROM hit GROUP BY host, day)
SELECT page_id, host, s.day AS fetch_day, coalesce(n_active, 0)::BIGINT AS n_active, lists, pattern, n_active IS NOT NULL AS blocked
FROM seen s LEFT JOIN verdict USING (host, day)""")
def op7(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", "url", F.date_add(F.lit(_FIRST_DAY).cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("fetch_day"))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    judged = url_filter.judge(pages, list_entries(hosts), F.col("url"), F.col("fetch_day"))
    return judged.select("row.page_id", "host", F.col("day").alias("fetch_day"), "n_active", "lists", "pattern", "blocked")


@_query("op5_warc")
def op5(t: Tables) -> DataFrame:
    return warc.read_archives(warc.write_archives(t.pages))


def language_profiles(docs: DataFrame) -> language.Profiles:
    """Profiles learned from the documents outside the held-out fold; a null id is outside it but isn't learned from."""
    return language.learn(docs.where(F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id"))))


@_query("op8_language_id")
def op8(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", "lang")
    found = language.predict(docs.select("doc_id", "text"), language_profiles(docs))
    return found.select("row.doc_id", language.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@_query("op6_decontamination")
def op6(t: Tables) -> DataFrame:
    found = decontaminate.find_leaks(t.documents, t.benchmark, carry=["doc_id"])
    return found.select("row.doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.edits", "leak.end")


@_query("op1_main_text")
def op1(t: Tables) -> DataFrame:
    return page_text.main_text(t.pages)


def _values(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PATH_SQL = """coalesce(source, 'none') || '/' || CASE WHEN doc_id % 1000 = 0 THEN 'LICENSE' WHEN doc_id % 100 = 0 THEN coalesce(lang, 'none') || '/LICENSE'
  ELSE coalesce(lang, 'none') || '/' || (doc_id // 16 % 64)::VARCHAR || CASE WHEN doc_id % 10 = 0 THEN '/LICENSE' ELSE '/' || doc_id::VARCHAR || '.txt' END END"""


def document_path(doc_id: Column, lang: Column, source: Column) -> Column:
    """A place in a file tree for a document; the tables have none. Each tenth one is a licence file at some level."""
    lang, source = F.coalesce(lang, F.lit("none")), F.coalesce(source, F.lit("none"))
    shard = (F.floor(doc_id / 16) % 64).cast("string")
    return F.concat(source, F.lit("/"), F.when(doc_id % 1000 == 0, "LICENSE").when(doc_id % 100 == 0, F.concat(lang, F.lit("/LICENSE"))).otherwise(
        F.concat(lang, F.lit("/"), shard, F.when(doc_id % 10 == 0, "/LICENSE").otherwise(F.concat(F.lit("/"), doc_id.cast("string"), F.lit(".txt"))))))


@_query("op3_licences", f"""
WITH templates AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_values(g)}, {_values(x)})" for i, (g, x) in enumerate(licences.TEMPLATES))}) AS v(t, licence, text)),
tt AS (SELECT t, licence, term, count(*) AS tf FROM (SELECT t, licence, unnest(regexp_extract_all(lower(text), '{licences.TERM}')) AS term FROM templates) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM templates)) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT t, licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS weight FROM tt JOIN idf USING (term)),
files AS (SELECT doc_id, text, {_PATH_SQL} AS path FROM documents),
marked AS (SELECT row_number() OVER () AS rid, path, string_split(text, chr(10)) AS ls, text, regexp_matches(lower(regexp_extract(path, '[^/]*$')), '{licences.LICENCE_FILE}') AS whole FROM files WHERE text IS NOT NULL),
lines AS (
  SELECT path, line, lag(line) OVER (PARTITION BY rid ORDER BY i) AS above, lead(line) OVER (PARTITION BY rid ORDER BY i) AS below
  FROM (SELECT rid, path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM marked)),
passages AS (
  SELECT path, line AS passage FROM lines WHERE regexp_matches(lower(line), '{licences.MARKER}')
  UNION SELECT path, concat_ws(' ', above, line, below) FROM lines WHERE regexp_matches(lower(line), '{licences.MARKER}')
  UNION SELECT path, text FROM marked WHERE whole),
pt AS (SELECT passage, term, count(*) AS tf FROM (SELECT passage, unnest(regexp_extract_all(lower(passage), '{licences.TERM}')) AS term FROM (SELECT DISTINCT passage FROM passages)) GROUP BY ALL),
pw AS (SELECT passage, term, idf, tf * coalesce(idf, ln(1 + (SELECT count(*) FROM templates)) + 1) AS x FROM pt LEFT JOIN idf USING (term)),
norm AS (SELECT passage, sqrt(sum(x * x)) AS norm FROM pw GROUP BY passage),
score AS (SELECT passage, licence, round(sum(x * weight) / max(norm), 6) AS score FROM pw JOIN tw USING (term) JOIN norm USING (passage) GROUP BY passage, t, licence),
own AS (SELECT path, (array_agg(licence ORDER BY score DESC, licence))[1] AS own, max(score) AS score FROM passages JOIN score USING (passage) WHERE score >= {licences.MIN_COSINE} GROUP BY path),
given AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, (array_agg(own ORDER BY score DESC, path))[1] AS given FROM own
  WHERE regexp_matches(lower(regexp_extract(path, '[^/]*$')), '{licences.LICENCE_FILE}') GROUP BY 1),
near AS (
  SELECT f.path, (array_agg(g.given ORDER BY length(g.dir) DESC))[1] AS given, (array_agg(g.dir ORDER BY length(g.dir) DESC))[1] AS dir
  FROM (SELECT DISTINCT path FROM files) f JOIN given g ON g.dir = '' OR starts_with(regexp_replace(f.path, '/?[^/]*$', '') || '/', g.dir || '/') GROUP BY f.path)
SELECT doc_id, files.path, own, score, coalesce(own, given) AS licence, CASE WHEN own IS NULL THEN dir END AS inherited_from
FROM files LEFT JOIN own ON files.path = own.path LEFT JOIN near ON files.path = near.path""")
def op3(t: Tables) -> DataFrame:
    spark = t.documents.sparkSession
    templates = spark.createDataFrame([(i, *x) for i, x in enumerate(licences.TEMPLATES)], "t int, licence string, text string")
    path = document_path(F.col("doc_id"), F.col("lang"), F.col("source"))
    return licences.scan(t.documents.select("doc_id", "text", path.alias("path")), templates, F.col("path"), F.col("text"), ["doc_id"]).select(
        "row.doc_id", "path", "own", "score", "licence", "inherited_from")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults: rows dropped, emptied, cut off, repeated (``copies``) or given to the user."""
    space = F.lit(" ")
    text = F.coalesce("text", space)
    d = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    return turns.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(d == 1, "").when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"))


@_query("op11_conversation_repair")
def op11(t: Tables) -> DataFrame:
    found = conversation.repair(damaged(t.conversations), copies=F.col("copies"))
    signed = conversation.digests(found.turns).withColumnRenamed("conv_id", "d_conv")
    both = found.reports.hint("merge").join(signed, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left")
    return both.drop("d_conv").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


#: Vocabulary of the subword model.
PIECES = "piece_bpe_32k.model"


def scoring_fold(doc_id: Column) -> Column:
    """Whether a document is held out from language-model training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@_query("op12_lattice_score")
def op12(t: Tables) -> DataFrame:
    import public_tokenizers

    docs = t.documents.select("doc_id", "text")
    # a null id is outside the held-out fold but isn't learned from
    training = docs.where(F.col("doc_id").isNotNull() & ~scoring_fold(F.col("doc_id"))).select("text")
    counts = stored(lattice.word_counts(training), "word-counts")
    pieces = lattice.fit(counts, lattice.vocabulary(public_tokenizers.path(PIECES)))
    scored = lattice.score(docs, counts, pieces)
    return scored.select("row.doc_id", scoring_fold(F.col("row.doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op13_filter_audit", f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}+') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), FALSE) AS copy FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
                regexp_matches(t, '[#$%&*|]'), copy] AS fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n
  FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
seen AS (
  SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS letter, fails[strpos('ABCDE', substr(filter_order, step, 1))] AS here,
         len(list_filter(range(1, step), lambda k: fails[strpos('ABCDE', substr(filter_order, k, 1))])) > 0 AS before, len(list_filter(fails, lambda f: f)) AS failed
  FROM m, orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
counted AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT here AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT before), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (here AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (here AND NOT before AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (here AND NOT before AND toxic), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted""")
def op13(t: Tables) -> DataFrame:
    return filter_audit.filter_audit(t.documents, t.labels)
