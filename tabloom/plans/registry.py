"""Named queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the Parquet tables of one folder: ``Tables(spark, dir).lineitem``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its optional oracle."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, **by_column: int) -> DataFrame:
    """Round double columns so that summation order does not show; -0.0 becomes 0.0."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), by_column.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def sql_rounded(sql: str, keep: str, digits: int, columns: str, **by_column: int) -> str:
    """The SQL twin of :func:`rounded`: ``keep`` as they are, ``columns`` rounded."""
    parts = [k for k in keep.split()]
    parts += [f"round({c}, {by_column.get(c, digits)}) + 0.0 AS {c}" for c in columns.split()]
    return f"SELECT {', '.join(parts)} FROM ({sql}) AS r"
