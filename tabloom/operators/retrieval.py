"""Vector and lexical top-k retrieval and the metadata corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ident
from ..functions.lineage import cut_lineage
from ..functions.skew import join_hot_keys, spread
from .nearest import nearest
from .privacy import guarded_columns
from .profile import readiness, roles, target_task

#: Index rows of a word and size class that one task takes, seeds looked at per word, and rare words that give seeds.
POSTINGS, SEEDS, SEED_WORDS = 100_000, 64, 8


def vector_search(docs: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 5) -> DataFrame:
    """Exact cosine top-k per query between two distributed tables; see :func:`.nearest.nearest`."""
    return nearest(docs, key, vector, queries, query_key, query_vector, k)


def token_set(c):
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0)))


def _size_class(n):
    """Classes of set sizes, each twice as wide as the one before."""
    return F.floor(F.log2(n.cast("double"))).cast("int")


def lexical_search(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int = 5) -> DataFrame:
    """Exact Jaccard top-k over word sets; documents without a common word are left out.

    An inverted index lists the documents of each word that some query has. The shortest documents of a query's rarest
    words are compared first; the k-th best of them is a floor under the query's results. With its words in order of
    rarity, a document that shares none of the first i-1 words can reach the floor only if it is short enough, so the
    i-th word is looked up among documents of such sizes alone: hardly any for frequent words. Frequent words are also
    split over tasks. Pairs found are compared by their whole sets. Rows are told apart by their number, so keys may repeat.
    """
    numbered = lambda df, c, t, names: cut_lineage(df.select(ident(c).alias(names[0]), token_set(ident(t)).alias(names[1])).where(
        F.size(names[1]) > 0).withColumn(names[2], F.monotonically_increasing_id()).withColumn(names[3], F.size(names[1])))
    d = numbered(docs, key, text, ("k", "d", "doc", "nd"))
    q = numbered(queries, query_key, query_text, ("q", "t", "ask", "nq"))
    asked = q.select(F.explode("t").alias("word")).distinct()
    words = d.select("doc", "nd", F.explode("d").alias("word"))
    df = cut_lineage(words.groupBy("word").agg(F.count("*").alias("df")).join(asked, "word", "left_semi"))
    # a frequent word is split over slots
    index = cut_lineage(join_hot_keys(words, df, ["word"], "df").select(
        "word", _size_class(F.col("nd")).alias("class"), F.pmod(F.xxhash64("doc"), spread("df", POSTINGS)).cast("int").alias("slot"), "doc", "nd"))
    lists = index.select(F.col("word").alias("l_word"), "class", "slot").distinct()
    terms = q.select("ask", "nq", F.explode("t").alias("word")).join(df, "word")
    order = W.partitionBy("ask").orderBy("df", "word")
    # i counts the query's words from the rarest; words of no document come first of all and only raise it
    missing = F.col("nq") - F.count("*").over(W.partitionBy("ask"))
    terms = cut_lineage(terms.select("ask", "nq", "word", "df", F.row_number().over(order).alias("r"), (F.row_number().over(order) + missing).alias("i")))

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(q.select("ask", "t"), "ask").join(d.select("doc", "d", "k"), "doc")
        shared = F.size(F.array_intersect("t", "d")).cast("double")
        return both.select("ask", "doc", "k", (shared / (F.size("t") + F.size("d") - shared)).alias("score"))

    best = W.partitionBy("ask").orderBy(F.col("score").desc(), "k")
    # a row of the index is a seed if it is among the shortest of its word; ranks are cut off before the shuffle
    short = W.partitionBy("word").orderBy("nd", "doc")
    seeds = index.select("word", "doc", F.row_number().over(short).alias("at")).where(F.col("at") <= SEEDS)
    first = compared(terms.where(F.col("r") <= SEED_WORDS).select("ask", "word").join(seeds, "word").select("ask", "doc").distinct())
    floor = first.select("ask", "score", F.row_number().over(best).alias("at")).where(F.col("at") == k).select(F.col("ask").alias("f_ask"), (F.col("score") * (1 - 1e-12)).alias("floor"))
    bounded = terms.join(floor, F.col("ask") == F.col("f_ask"), "left")
    # sharing words i to nq at most, a set of nd words has a score of at most o / (nq + nd - o)
    o = F.col("nq") - F.col("i") + 1
    longest = F.when(F.col("floor").isNotNull(), F.floor(o * (1 + F.col("floor")) / F.col("floor") - F.col("nq") + 1e-6))
    shortest = F.coalesce(F.ceil(F.col("floor") * F.col("nq") - 1e-6), F.lit(1))
    probes = bounded.select("ask", "word", longest.alias("longest"), shortest.alias("shortest"))
    probes = probes.join(lists, (F.col("word") == F.col("l_word")) & (F.col("class") >= _size_class(F.greatest("shortest", F.lit(1)))) & (
        F.col("longest").isNull() | ((F.col("longest") >= 1) & (F.col("class") <= _size_class(F.greatest("longest", F.lit(1)))))))
    met = probes.join(index, ["word", "class", "slot"]).where((F.col("longest").isNull() | (F.col("nd") <= F.col("longest"))) & (F.col("nd") >= F.col("shortest")))
    found = compared(met.select("ask", "doc").distinct())
    ranked = found.select("ask", "k", "score", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)
    return ranked.join(q.select("ask", "q"), "ask").select(F.col("q").alias(query_key), F.col("k").alias(key), "score", "rank")


def corpus(df: DataFrame, target: str | None = None, glossary: DataFrame | None = None, protected: Sequence[str] | None = None) -> DataFrame:
    """``chunk_id, source_type, text`` describing the table, its columns, readiness, target and glossary terms."""
    hidden = list(protected) if protected is not None else guarded_columns(df.columns)
    r = roles(df)
    sample = F.when(F.col("column").isin(hidden or [""]), "[redacted]").when(F.length("sample_values") > 0, F.col("sample_values")).otherwise("(none)")
    columns = r.select(
        F.concat(F.lit("column:"), "column").alias("chunk_id"), F.lit("column_profile").alias("source_type"),
        F.format_string("Column '%s' (dtype %s). Role: %s (%s confidence). Missing: %s%%. Unique: %s. Sample values: %s.", "column", "dtype", "role",
                        "confidence_label", F.col("null_pct").cast("string"), F.col("unique_count").cast("string"), sample).alias("text"),
    )
    per = r.groupBy("role").agg(F.count("*").alias("k"), F.max("rows").alias("rows"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat(F.col("k").cast("string"), F.lit(" "), "role"))), ", ")
    overview = per.agg(F.max("rows").alias("rows"), listed.alias("roles")).select(
        F.lit("overview").alias("chunk_id"), F.lit("dataset_overview").alias("source_type"),
        F.format_string("Dataset overview: %s rows, %s columns. Column roles: %s.", F.col("rows").cast("string"), F.lit(str(len(df.columns))), "roles").alias("text"),
    )
    out = columns.unionByName(overview)
    if target:
        ready = readiness(df, target).select(F.lit("readiness:overview").alias("chunk_id"), F.lit("readiness").alias("source_type"),
                                             F.format_string("Data readiness verdict: %s (score %s/100).", "verdict", F.col("score").cast("string")).alias("text"))
        task = target_task(df, target).select(F.lit("target").alias("chunk_id"), F.lit("target").alias("source_type"),
                                              F.format_string("Target column '%s': task type is %s.", "target", "task_type").alias("text"))
        out = out.unionByName(ready).unionByName(task)
    if glossary is not None:
        out = out.unionByName(glossary.where(F.length(F.trim("term")) > 0).select(
            F.concat(F.lit("dict:"), F.lower(F.trim("term"))).alias("chunk_id"), F.lit("dictionary").alias("source_type"),
            F.format_string("Business term '%s': %s", F.trim("term"), F.trim("definition")).alias("text"),
        ))
    return out
