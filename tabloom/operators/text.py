"""Text columns: detection, lexical features, sentiment, TF-IDF and truncated SVD embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ident, string_columns
from ..functions.lineage import cut_lineage
from .profile import cell_counts

# Sentiment words.
POSITIVE = ["good", "great", "excellent", "amazing", "love", "best", "fast", "happy", "reliable", "perfect"]
NEGATIVE = ["bad", "poor", "terrible", "worst", "hate", "slow", "error", "fail", "broken", "issue", "bug"]
WORD = r"[\p{L}\p{N}_]+"


def word_count(c: Column) -> Column:
    """Whitespace-separated words."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, r"\s+")))


def simple_text_columns(df: DataFrame, min_words: float = 3.0) -> DataFrame:
    """``column, avg_words, is_text``."""
    cols = string_columns(df)
    return _stats(df, cols, [("avg_words", lambda c: F.avg(word_count(ident(c))))]).withColumn("is_text", F.coalesce(F.col("avg_words") >= min_words, F.lit(False)))


def _stats(df: DataFrame, cols: Sequence[str], measures) -> DataFrame:
    aggs = [fn(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, fn in measures]
    items = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{n}_{i}").alias(n) for n, _ in measures]) for i, c in enumerate(cols)])
    return df.agg(*aggs).select(F.explode(items).alias("e")).select("e.*")


def strict_text_columns(df: DataFrame, exclude: Sequence[str] = (), min_words: float = 3.0, min_unique: float = 0.3) -> DataFrame:
    """Free-text test on all non-blank cells: distinctness, words, length and its spread, not dates."""
    cols = string_columns(df, exclude)
    trimmed = df.select(*[F.when(F.length(F.trim(ident(c))) > 0, F.trim(ident(c))).alias(c) for c in cols])
    s = _stats(trimmed, cols, [
        ("rows", lambda c: F.count(ident(c))), ("avg_words", lambda c: F.avg(F.regexp_count(ident(c), F.lit(WORD)))),
        ("avg_length", lambda c: F.avg(F.length(ident(c)))), ("length_variance", lambda c: F.var_pop(F.length(ident(c)))),
        ("date_rate", lambda c: F.avg(F.when(ident(c).isNotNull(), F.try_to_timestamp(ident(c)).isNotNull().cast("double")))),
    ])
    d = cell_counts(trimmed, cols).groupBy("column").agg(F.count("*").alias("distinct"))
    x = s.join(F.broadcast(d), "column", "left").withColumn("unique_ratio", F.coalesce(F.try_divide(F.col("distinct").cast("double"), F.col("rows")), F.lit(0.0)))
    ok = (
        (F.col("rows") >= 3) & (F.col("unique_ratio") >= min_unique) & (F.col("avg_words") >= min_words) & (F.col("avg_length") >= 12.0)
        & (F.col("length_variance") >= 15.0) & (F.col("date_rate") < 0.8)
    )
    return x.select("column", "rows", "unique_ratio", "avg_words", "avg_length", "length_variance", F.coalesce(ok, F.lit(False)).alias("is_text"))


def sentiment(c: Column) -> Column:
    """(positive - negative) / (positive + negative) over distinct words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)))
    pos = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in POSITIVE])))
    neg = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in NEGATIVE])))
    return F.when(pos + neg > 0, (pos - neg) / (pos + neg)).otherwise(0.0)


def lexical_features(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Adds length, word, case, digit, punctuation and sentiment columns."""
    p, c = prefix or column, F.coalesce(ident(column), F.lit(""))
    chars, words = F.length(c), word_count(c)
    return df.withColumns({
        f"{p}_char_count": chars, f"{p}_word_count": words, f"{p}_avg_word_len": chars / F.greatest(words, F.lit(1)),
        f"{p}_uppercase_ratio": F.regexp_count(c, F.lit(r"\p{Lu}")) / F.greatest(chars, F.lit(1)),
        f"{p}_digit_ratio": F.regexp_count(c, F.lit(r"\d")) / F.greatest(chars, F.lit(1)),
        f"{p}_exclamations": F.regexp_count(c, F.lit("!")), f"{p}_questions": F.regexp_count(c, F.lit(r"\?")), f"{p}_sentiment_score": sentiment(c),
    })


# ---- TF-IDF ----


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def terms(c: Column, stop_words: Sequence[str] = (), min_length: int = 1) -> Column:
    """Words and adjacent word pairs after stop words are removed."""
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))
    words = F.filter(words, lambda w: (F.length(w) >= min_length) & ~F.array_contains(stop, w))
    return words


def _with_pairs(words: Column) -> Column:
    n = F.size(words)
    pairs = F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(words, pairs)


@dataclass
class TfIdf:
    """Vocabulary (bounded by max_terms) and long weights ``key, term_id, weight``."""

    key: str
    vocabulary: DataFrame
    weights: DataFrame
    size: int
    rows: int


def term_counts(df: DataFrame, key: str, column: str, stop_words: Sequence[str] | None = None, min_length: int = 1) -> DataFrame:
    """``key, term, tf`` of words and word pairs."""
    stop = english_stop_words() if stop_words is None else stop_words
    words = df.select(ident(key).alias(key), terms(ident(column), stop, min_length).alias("_w"))
    return words.select(key, F.explode(_with_pairs(F.col("_w"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def fit_vocabulary(counts: DataFrame, rows: int, max_terms: int) -> DataFrame:
    """``term_id, term, idf``: the most frequent terms with idf = ln((1+n)/(1+df)) + 1."""
    top = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.col("total").desc(), "term").limit(max_terms)
    w = W.orderBy("term")
    return top.select((F.row_number().over(w) - 1).alias("term_id"), "term", "df", (F.log((1.0 + rows) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weigh(counts: DataFrame, key: str, vocabulary: DataFrame, sublinear: bool) -> DataFrame:
    """L2-normalised tf-idf weights; the vocabulary has at most max_terms rows, so it is broadcast."""
    tf = 1.0 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    raw = counts.join(F.broadcast(vocabulary.select("term", "term_id", "idf")), "term").select(key, "term_id", "term", (tf * F.col("idf")).alias("_x"))
    per_row = W.partitionBy(key)
    return raw.select(key, "term_id", "term", (F.col("_x") / F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(per_row))).alias("weight"))


def tfidf(df: DataFrame, key: str, column: str, max_terms: int = 5000, sublinear: bool = True, stop_words: Sequence[str] | None = None, min_length: int = 1) -> TfIdf:
    counts = term_counts(df, key, column, stop_words, min_length)
    rows = df.count()
    head = fit_vocabulary(counts, rows, max_terms).collect()
    if stop_words is None and not head and rows:
        return tfidf(df, key, column, max_terms, sublinear, [], min_length)
    vocabulary = df.sparkSession.createDataFrame([tuple(r) for r in head], "term_id int, term string, df long, idf double")
    return TfIdf(key, vocabulary, weigh(counts, key, vocabulary, sublinear), len(head), rows)


# ---- truncated SVD ----


@dataclass
class Embedding:
    """Right singular vectors (terms x k, bounded) and singular values of a TF-IDF table."""

    components: np.ndarray
    singular: np.ndarray
    explained: list[float]


def _gram_times(packed: DataFrame, size: int, block: np.ndarray) -> np.ndarray:
    """AᵀA times a bounded block of columns, where the rows of ``packed(terms, weights)`` are those of A.

    Each task multiplies its rows in Arrow batches and hands on one sum per term and column.
    """
    sent = packed.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, out = sent.value, np.zeros_like(sent.value)
        for b in batches:
            terms, weights = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
            row = pc.list_parent_indices(b.column(0)).to_numpy()
            for j in range(q.shape[1]):
                y = np.bincount(row, weights * q[terms, j], b.num_rows)
                out[:, j] += np.bincount(terms, weights * y[row], size)
        used = np.flatnonzero(np.abs(out).sum(1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, used.size * out.shape[1] + 1, out.shape[1]), pa.int32()), pa.array(out[used].ravel()))
        yield pa.record_batch([pa.array(used), flat], names=["term_id", "x"])

    parts = packed.mapInArrow(run, "term_id long, x array<double>")
    sums = parts.groupBy("term_id").agg(*[F.sum(F.col("x")[j]).alias(f"x{j}") for j in range(block.shape[1])]).toArrow()
    sent.destroy()
    product = np.zeros_like(block)
    if sums.num_rows:
        product[sums["term_id"].to_numpy()] = np.stack([sums[f"x{j}"].to_numpy() for j in range(block.shape[1])], axis=1)
    return product


def fit_svd(model: TfIdf, k: int = 8, tolerance: float = 1e-9, passes: int = 60, seed: int = 42) -> Embedding:
    """Distributed SVD of the sparse rows; k is at most the vocabulary and rows - 1.

    A random range finder with power iterations: a seeded block of directions is multiplied by AᵀA, pass by pass over
    the stored rows, and the wanted vectors are taken from the span of all passes, until what is left of each falls
    below ``tolerance`` times the largest value. Only blocks of (terms x k + 8) numbers reach the driver.
    """
    size = model.size
    k = max(1, min(k, size, max(1, model.rows - 1)))
    entries = F.sort_array(F.collect_list(F.struct("term_id", "weight")))
    packed = model.weights.groupBy(model.key).agg(entries.alias("e")).select(
        F.transform("e", lambda e: e["term_id"]).alias("terms"), F.transform("e", lambda e: e["weight"]).alias("weights"))
    packed = cut_lineage(packed)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, k + 8))))[0]
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(passes):
        basis, image = np.hstack([basis, x]), np.hstack([image, _gram_times(packed, size, x)])
        lam, s = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        lam, s = lam[::-1][:k], s[:, ::-1][:, :k]
        left = np.linalg.norm(image @ s - basis @ s * lam, axis=0).max()
        if left <= tolerance * max(lam[0], 1e-300) or basis.shape[1] >= size:
            break
        # the newest images without what the basis holds already
        x = image[:, -x.shape[1]:]
        for _ in range(2):
            x = x - basis @ (basis.T @ x)
        u, weight, _ = np.linalg.svd(x, full_matrices=False)
        x = u[:, weight > 1e-12 * max(lam[0], 1e-300)][:, :size - basis.shape[1]]
        if not x.shape[1]:
            break
        x = np.linalg.qr(x - basis @ (basis.T @ x))[0]
    v, s = basis @ s, np.sqrt(np.maximum(lam, 0.0))
    total = model.weights.groupBy("term_id").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    n = float(model.rows)
    whole = total.agg(F.sum(F.col("q") / n - F.pow(F.col("s") / n, 2))).first()[0] or 1.0
    sums = {r["term_id"]: r["s"] for r in total.select("term_id", "s").collect()}
    mean = np.array([sums.get(i, 0.0) for i in range(model.size)]) / n
    var = s**2 / n - (mean @ v) ** 2
    return Embedding(v, s, [float(x / whole) for x in var])


def embed(model: TfIdf, svd: Embedding, prefix: str) -> DataFrame:
    """``key, <prefix>_0 ...``: each row's weights times the singular vectors."""
    k = svd.components.shape[1]
    rows = [(i, *[float(x) for x in svd.components[i]]) for i in range(model.size)]
    names = [f"c{j}" for j in range(k)]
    v = model.weights.sparkSession.createDataFrame(rows, "term_id int, " + ", ".join(f"{c} double" for c in names))
    x = model.weights.join(F.broadcast(v), "term_id")
    return x.groupBy(model.key).agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"{prefix}_{j}") for j, c in enumerate(names)])


def top_terms(model: TfIdf, svd: Embedding, n: int = 8) -> DataFrame:
    """``component, rank, term, weight, explained``: heaviest terms of each component by absolute weight."""
    names = {r["term_id"]: r["term"] for r in model.vocabulary.select("term_id", "term").collect()}
    rows = []
    for j in range(svd.components.shape[1]):
        w = np.abs(svd.components[:, j])
        for rank, i in enumerate(sorted(range(len(w)), key=lambda i: (-w[i], names[i]))[:n]):
            if w[i] > 1e-6:
                rows.append((j, rank + 1, names[i], float(svd.components[i, j]), svd.explained[j]))
    return model.weights.sparkSession.createDataFrame(rows, "component int, rank int, term string, weight double, explained double")


def fuse(df: DataFrame, key: str, columns: Sequence[str], k: int = 8, max_terms: int = 5000, drop_text: bool = False) -> DataFrame:
    """The table with ``text_<column>_svd_<i>`` columns; rows without known terms get zeros."""
    out = df
    for c in columns:
        model = tfidf(df, key, c, max_terms)
        if not model.size:
            continue
        dense = embed(model, fit_svd(model, k), f"text_{c}_svd")
        out = out.join(dense, key, "left").fillna(0.0, subset=[x for x in dense.columns if x != key])
    return out.drop(*columns) if drop_text else out
