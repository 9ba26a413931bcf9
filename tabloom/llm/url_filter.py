"""URL filters by a temporal list join, in DataFrame functions only.

Dated add and remove entries of block lists become validity intervals; every capture is judged by the entries whose
interval holds its fetch date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scheme, optional user part, host. Longer hosts than DNS allows count as invalid.
HOST_PATTERN = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
MAX_HOST = 253


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without a trailing dot; empty if there is none or it is too long."""
    host = F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST_PATTERN, 1), r"\.$", "")
    return F.when(F.length(host) <= MAX_HOST, host).otherwise("")


def suffixes(host: Column) -> Column:
    """The host itself and its parent domains: ``a.b.c`` gives ``a.b.c``, ``b.c``, ``c``."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``(list, pattern, valid_from, valid_to)`` from ``entries(list, pattern, day, action)``; open ends are null.

    Of several entries of one day a removal wins. Repeated additions or removals change nothing. Entries with a null
    in any column, or with an unknown action, are left out. A pattern has at most one state a day, which bounds the
    ordered window.
    """
    state = (
        entries.where(F.col("action").isin("add", "remove")).dropna(subset=["list", "pattern", "day"])
        .groupBy("list", "pattern", "day").agg((F.max(F.when(F.col("action") == "remove", 1).otherwise(0)) == 0).alias("on"))
    )
    w = Window.partitionBy("list", "pattern").orderBy("day")
    turns = state.withColumn("was", F.lag("on", 1, False).over(w)).where(F.col("on") != F.col("was"))
    ends = turns.withColumn("valid_to", F.lead("day").over(w))
    return ends.where("on").select("list", F.lower("pattern").alias("pattern"), F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: Column, day: Column) -> DataFrame:
    """``(row, host, day, n_active, lists, pattern, blocked)``: every capture, ``row`` being all its columns.

    An entry matches a host equal to its pattern or below it. The verdict depends on host and day alone, so the as-of
    join runs over distinct (host, day) pairs, and only hosts that some entry matches take part. ``n_active`` counts
    the active (list, pattern) pairs, ``lists`` joins their distinct lists in order, ``pattern`` is the longest
    (first in order on ties). A null day or a URL without host matches nothing; repeated captures stay repeated.
    """
    seen = captures.select(F.struct("*").alias("row"), host_of(url).alias("host"), day.alias("day"))
    hosts = seen.select("host").where("host <> ''").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("pattern"))
    listed = hosts.join(validity_intervals(entries), "pattern")
    pairs = seen.select("host", "day").where("day is not null").distinct()
    active = pairs.join(listed, "host").where("valid_from <= day and (valid_to is null or day < valid_to)")
    verdict = active.groupBy("host", "day").agg(
        F.countDistinct("list", "pattern").alias("n_active"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.min(F.struct((-F.length("pattern")).alias("k"), "pattern"))["pattern"].alias("pattern"),
    ).withColumnsRenamed({"host": "v_host", "day": "v_day"})
    return seen.join(verdict, (seen["host"] == verdict["v_host"]) & (seen["day"] == verdict["v_day"]), "left").select(
        "row", "host", "day", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "lists", "pattern", F.col("n_active").isNotNull().alias("blocked"))
