"""Business glossary as a keyed table: one definition per tenant and term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.privacy import scan
from .readers import SourceError


def load(df: DataFrame) -> DataFrame:
    """Trimmed ``term, definition`` rows of a raw table; blank terms are dropped."""
    named = df.toDF(*[c.strip().lower() for c in df.columns])
    missing = {"term", "definition"} - set(named.columns)
    if missing:
        raise SourceError(f"a glossary needs term and definition; missing {sorted(missing)}")
    return (
        named.select(F.trim(F.col("term").cast("string")).alias("term"), F.trim(F.col("definition").cast("string")).alias("definition"))
        .where(F.length("term") > 0)
    )


def safe_to_keep(entries: DataFrame) -> bool:
    """True when no column of the glossary looks like personal data."""
    return scan(entries).isEmpty()


def upsert(current: DataFrame, entries: DataFrame) -> DataFrame:
    """Latest definition per (tenant, lower(term)); both sides have ``tenant, term, definition, updated_at``.

    ``max_by`` combines map-side, so a tenant or term with very many versions
    never lands in one task.  The spelling of the first entry is kept.
    """
    both = current.select("tenant", "term", "definition", "updated_at").unionByName(
        entries.select("tenant", "term", "definition", "updated_at")
    ).where(F.length(F.trim("term")) > 0)
    newest = F.struct("updated_at", "definition")
    oldest = F.struct("updated_at", "term")
    return both.groupBy("tenant", F.lower(F.trim("term")).alias("key")).agg(
        F.min(oldest)["term"].alias("term"), F.max(newest)["definition"].alias("definition"),
        F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
    )


def delete(current: DataFrame, removed: DataFrame) -> DataFrame:
    """``current`` without the (tenant, term) pairs listed in ``removed``, letter case aside."""
    gone = removed.select("tenant", F.lower(F.trim("term")).alias("_key")).distinct()
    keyed = current.withColumn("_key", F.lower(F.trim("term")))
    return keyed.join(gone, ["tenant", "_key"], "left_anti").drop("_key")


def count_terms(current: DataFrame) -> DataFrame:
    return current.groupBy("tenant").agg(F.count("*").alias("terms"))
