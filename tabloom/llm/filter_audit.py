"""Interaction of quality filters: every order of application, walked by a recursive query over mask cells.

Each document gets one bit per filter that it fails. Documents with equal bits form a cell of their part, so all that
the recursion needs are at most 32 cells a part, whatever the number of documents. The recursive query starts from the
empty prefix, extends each prefix by every unused letter, joins the part's cells and carries the bits applied so far;
each level of the recursion emits the metrics of that step.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.skew import join_hot_keys
from tabloom.llm.common import stored

#: Separators of words, and the limits of the text filters.
SPACE_RUN = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, r"[#$%&*|]"
FILTERS = "ABCDE"
#: The filter that looks at the whole table instead of one text.
COPIES = 1 << FILTERS.index("E")
#: Rows that the recursion makes for each part: all prefixes without repeated letters.
PREFIXES = sum(len(list(permutations(FILTERS, k))) for k in range(len(FILTERS) + 1))


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (null is an empty text)."""
    plain = F.coalesce(text, F.lit(""))

    def bits(words: Column) -> Column:
        capitals = F.length(plain) - F.length(F.regexp_replace(plain, "[A-Z]+", ""))
        fails = [
            F.size(words) < MIN_WORDS,
            100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
            100 * capitals > MAX_CAPITAL_PERCENT * F.length(plain),
            plain.rlike(SYMBOLS),
        ]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    words = F.filter(F.split(plain, SPACE_RUN), lambda w: w != "")
    return F.transform(F.array(words), bits)[0]


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part that fail exactly the filters in ``mask``.

    A document fails E if a smaller id has the same text; a null id has no smaller one and is none itself, and rows
    that repeat an id don't count against each other. ``good`` and ``toxic`` count documents that any row of ``labels``
    with their id calls so. Parts are the values of ``part_col``, null being the empty string.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_mask(F.col(text_col)).alias("mask"), F.unhex(F.sha2(text, 256)).alias("same")), "masks")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"))
    known = slim.where("doc_id is not null").hint("merge").join(said, F.col("doc_id") == F.col("l_id"), "left")
    # null ids have no label and would meet in one task of the join
    known = known.unionByName(slim.where("doc_id is null"), allowMissingColumns=True)
    known = stored(known.select("doc_id", "part", "mask", "same", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]), "labelled")
    firsts = known.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1")
    later = join_hot_keys(known, stored(firsts, "repeated-texts"), ["same"], "times").where(F.col("doc_id") > F.col("first"))
    by = ["part", "mask", "good", "toxic"]
    every, copies = known.groupBy(*by).agg(F.count("*").alias("n")), stored(later.groupBy(*by).agg(F.count("*").alias("n")), "copies")
    moved = every.unionByName(copies.withColumn("n", -F.col("n"))).unionByName(copies.withColumn("mask", F.col("mask").bitwiseOR(F.lit(COPIES))))
    return moved.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


_CELLS = "aggregate(filter(cells, c -> {0}), 0L, (x, c) -> x + c.{1})"
_HIT, _BEFORE = "(c.mask & letter.bit) > 0", "(c.mask & applied)"
_WALK = f"""
WITH RECURSIVE walk (part, prefix, applied, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
  UNION ALL
  SELECT part, concat(prefix, letter.name), applied | letter.bit, step + 1, letter.name,
         {_CELLS.format("(c.mask & (applied | letter.bit)) = 0", "n")},
         {_CELLS.format(f"{_HIT} AND {_BEFORE} = 0", "n")},
         {_CELLS.format(f"{_HIT} AND {_BEFORE} > 0", "n")},
         {_CELLS.format("c.mask = letter.bit", "n")},
         {_CELLS.format(f"{_HIT} AND {_BEFORE} = 0", "good")},
         {_CELLS.format(f"{_HIT} AND {_BEFORE} = 0", "toxic")}
  FROM (
    SELECT walk.part, prefix, applied, step, cells,
           explode(filter(array({", ".join(f"named_struct('name', '{x}', 'bit', {1 << i})" for i, x in enumerate(FILTERS))}), l -> (applied & l.bit) = 0)) AS letter
    FROM walk JOIN {{cells}} AS c ON walk.part = c.part)
)
SELECT * FROM walk WHERE step > 0"""
_METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def order_audit(cells: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the counts after that step.

    ``cells(part, mask, n, good, toxic)`` as from :func:`mask_cells`. ``shapley`` is what the step's filter removes,
    summed over all orders. No cells give no rows.
    """
    spark = cells.sparkSession
    packed = stored(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "cells")
    limit, rows = "spark.sql.cteRecursionRowLimit", packed.count() * PREFIXES
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(max(int(before), rows + 1) if int(before) >= 0 else before))
    try:
        walk = stored(spark.sql(_WALK, cells=packed), "walk")
    finally:
        spark.conf.set(limit, before)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = walk.select("*", F.explode(F.filter(orders, lambda o: o.startswith(F.col("prefix")))).alias("filter_order"))
    total = steps.groupBy(F.col("part").alias("t_part"), F.col("letter").alias("t_letter")).agg(F.sum("removed").alias("shapley"))
    both = steps.join(total, (F.col("part") == F.col("t_part")) & (F.col("letter") == F.col("t_letter")))
    return both.select("part", "filter_order", "step", *_METRICS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of all orders of the five filters over whole ``docs``; see :func:`mask_cells` and :func:`order_audit`.

    Null and empty texts fail A (and E after a smaller id). Repeated rows count one by one. Empty ``docs`` give no rows.
    """
    return order_audit(mask_cells(docs, labels, id_col, text_col, part_col))
