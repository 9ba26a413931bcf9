"""Sinks for cleaned, masked and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Managed table, bucketed when later joins go by ``bucket_by``."""
    writer = df.write.mode(mode)
    (writer.bucketBy(buckets, bucket_by).sortBy(bucket_by) if bucket_by else writer).saveAsTable(name)
