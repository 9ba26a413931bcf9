"""Durable lineage cuts for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; only local sessions get a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to reliable storage so that lost executors do not replay every round."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a large ``df`` once as Parquet that all executors share, so that later passes read only the columns they need.

    Rows that lie in fewer parts than there are cores are spread first.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.select(F.spark_partition_id().alias("part")).distinct().count() < cores:
        df = df.repartition(cores)
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def even_parts(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew if its parts would leave a fifth of the cores idle in every pass over them.

    For rows that are large and few, such as packed blocks.
    """
    cores, n = df.sparkSession.sparkContext.defaultParallelism, max(1, df.rdd.getNumPartitions())
    return df if -(-n // cores) * cores <= 1.25 * n else df.repartition(cores * max(1, round(n / cores)))
