"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

All of it is built-in DataFrame functions. A sketch is a count per logarithmic bin (32 bins per power of two, so a
bin's bounds differ by about 3 %), for each group and measure; two sketches merge by adding counts, and the sketch of a
language or of the corpus is the sum of its groups' sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import SPACES, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A text fails when more than this percentage of its words lies in repeated 3-word windows.
MAX_REPEAT_PERCENT = 50
#: A group with fewer usable texts than this takes the cutoffs of its language, or of the corpus.
MIN_GROUP = 200
#: Fences lie this many spreads beyond the 10th and 90th percentile; a spread reaches from there to the median.
SPREADS = 3
#: Measures in thousandths with the least spread each is granted, and the one that also has a lower fence.
MEASURES = {"word_length": 250, "symbols_per_word": 25, "dup_lines_per_word": 10, "repeat_share": 60}
TWO_SIDED = "word_length"


def _bound(name: str, value: Column, use) -> Column:
    """Evaluate ``value`` once per row and use it, by name, in ``use``."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in the same text.

    Windows are hashed to 64 bits; only texts with a repeated hash sort their windows and look at the neighbours.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(ranked: Column) -> Column:
        last = F.size(ranked) - 1
        again = F.filter(
            F.transform(ranked, lambda x, i: F.when(
                ((i > 0) & (F.get(ranked, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(ranked, i + 1)["h"] == x["h"])), x["i"])),
            lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))

    def count(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_bound("r", ranked, covered))

    return F.when(F.size(words) < 4, 0).otherwise(_bound("h", windows, count))


def base_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` of every whole text."""
    plain = F.coalesce(F.col(text_col), F.lit(""))
    spaced = F.translate(plain, SPACES, " " * len(SPACES))
    lines = F.filter(F.split(plain, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    words = F.filter(F.split(spaced, " +"), lambda w: w != "")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        _bound("w", words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(plain, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bound("l", lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def bin_floor(v: Column) -> Column:
    """The lower bound of the logarithmic bin that holds the non-negative integer ``v``."""
    return v - v % F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - 6, F.lit(0))).cast("long")


def sketches(values: DataFrame, groups: list[str]) -> DataFrame:
    """``(groups, measure, bin, n)``: the sketch of each measure (``values`` has a column per measure) in each group."""
    long = values.select(*groups, F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])).alias("measure", "v"))
    return long.groupBy(*groups, "measure", bin_floor(F.col("v")).alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str], percents: dict[str, int]) -> DataFrame:
    """``(groups, measure, n, <name> ...)``: the bin that holds each percentile's rank, for merged sketches."""
    merged = sketch.groupBy(*groups, "measure", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*groups, "measure")
    up = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("bin"))).alias(name) for name, p in percents.items()]
    return up.groupBy(*groups, "measure").agg(F.max("all").alias("n"), *at)


def cutoffs(sketch: DataFrame) -> DataFrame:
    """Fences of every (lang, source, measure) of a sketch, with those of the language or corpus for small groups."""
    levels = []
    for depth, by in enumerate((["lang", "source"], ["lang"], [])):
        q = quantiles(sketch, by, {"low": 10, "mid": 50, "high": 90})
        least = F.create_map(*[F.lit(x) for m in MEASURES.items() for x in m])[F.col("measure")].cast("long")
        fence = q.select(*by, "measure", "n",
                         (F.col("low") - SPREADS * F.greatest(F.col("mid") - F.col("low"), least)).alias("floor"),
                         (F.col("high") + SPREADS * F.greatest(F.col("high") - F.col("mid"), least)).alias("top"))
        levels.append(fence.select(*by, "measure", *[F.col(c).alias(f"{c}{depth}") for c in ("n", "floor", "top")]))
    out = levels[0]
    by_lang = levels[1].withColumnsRenamed({"measure": "m1", "lang": "l1"})
    out = out.join(by_lang, (out["measure"] == by_lang["m1"]) & out["lang"].eqNullSafe(by_lang["l1"]))
    out = out.join(levels[2], "measure")
    pick = lambda c: F.when(F.col("n0") >= MIN_GROUP, F.col(f"{c}0")).when(F.col("n1") >= MIN_GROUP, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    return out.select("lang", "source", "measure", pick("floor").alias("floor"), pick("top").alias("top"))


def adaptive_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document with its base measures, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated 3-word windows. Documents that pass
    feed the sketches; they are kept when every measure lies within the fences of their (language, source), nulls
    being a group of their own. Null texts have no words and fail. Repeated rows are judged and counted one by one.
    """
    base = base_measures(docs, id_col, text_col, lang_col, source_col)
    share = lambda c: F.expr(f"({c} * 1000) div greatest(n_words, 1)")
    base = stored(base.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "word_length": share("word_chars"), "symbols_per_word": share("n_symbols"),
        "dup_lines_per_word": share("n_dup_lines"), "repeat_share": share("n_repeat_words"),
    }), "quality")
    sketch = stored(sketches(base.where(~F.col("base_failed")), ["lang", "source"]), "sketches")
    wide = cutoffs(sketch).groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}") for m in MEASURES for c in ("floor", "top")])
    within = F.lit(True)
    for m in MEASURES:
        within = within & (F.col(m) <= F.col(f"top_{m}"))
    within = within & (F.col(TWO_SIDED) >= F.col(f"floor_{TWO_SIDED}"))
    wide = wide.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    joined = base.join(wide, base["lang"].eqNullSafe(wide["g_lang"]) & base["source"].eqNullSafe(wide["g_source"]), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"))
