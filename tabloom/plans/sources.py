"""Readers and sinks (SRC, SAN-09): given tables written as files of each kind and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import shared_folder
from ..sources import readers, writers
from .registry import query

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"]
ORDERS = "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders"


def _orders(df: DataFrame) -> DataFrame:
    return df.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderpriority", F.col("o_totalprice").cast("double"))


@query("src_01_csv_semicolons", ORDERS)
def csv_semicolons(t):
    path = shared_folder(t.spark, "csv")
    writers.write_csv(t.orders.select(*ORDER_COLUMNS), path, sep=";")
    return _orders(readers.read_csv(t.spark, path))


@query("src_01_csv_pipes", ORDERS)
def csv_pipes(t):
    path = shared_folder(t.spark, "csv")
    writers.write_csv(t.orders.select(*ORDER_COLUMNS), path, sep="|")
    return _orders(readers.read_csv(t.spark, path))


@query("src_02_csv_latin_1", r"""
SELECT doc_id, lang, nullif(trim(translate(regexp_replace(text, '[^\x21-\xFF]+', ' ', 'g'), '"\', '  ')), '') AS text FROM documents""")
def csv_latin_1(t):
    """Whole texts as Latin-1: controls, quotes, backslashes and characters beyond it become spaces."""
    path = shared_folder(t.spark, "latin-1")
    plain = F.trim(F.translate(F.regexp_replace("text", r"[^\x21-\xFF]+", " "), '"\\', "  "))
    t.documents.select("doc_id", "lang", plain.alias("text")).write.option("header", True).option("encoding", "ISO-8859-1").option("emptyValue", "").csv(path)
    return readers.read_csv(t.spark, path).select(F.col("doc_id").cast("long"), "lang", "text")


def _uneven(t) -> tuple[str, T.StructType]:
    """Customers as lines of three fields, with two too many in each fifth line and one too few in the next."""
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 5 == 0, F.concat_ws(",", key, "c_name", F.col("c_nationkey").cast("string"), F.lit("x"), F.lit("y"))).when(
        F.col("c_custkey") % 5 == 1, F.concat_ws(",", key, "c_name")).otherwise(F.concat_ws(",", key, "c_name", F.col("c_nationkey").cast("string")))
    path = shared_folder(t.spark, "uneven")
    t.customer.select(line.alias("c_custkey,c_name,c_nationkey")).write.option("header", True).option("sep", "\u0001").csv(path)
    return path, T.StructType.fromDDL("c_custkey long, c_name string, c_nationkey int")


@query("src_03_uneven_rows", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 1 THEN c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 5 <> 0")
def uneven_rows(t):
    path, schema = _uneven(t)
    return readers.read_csv(t.spark, path, sep=",", schema=schema)


@query("src_03_malformed_lines", "SELECT concat_ws(',', c_custkey, c_name, c_nationkey, 'x', 'y') AS line FROM customer WHERE c_custkey % 5 = 0")
def malformed_lines(t):
    path, schema = _uneven(t)
    return readers.malformed_rows(t.spark, path, schema)


@query("src_04_tsv", ORDERS)
def tsv(t):
    path = shared_folder(t.spark, "tsv") + ".tsv"
    writers.write_csv(t.orders.select(*ORDER_COLUMNS), path, sep="\t")
    return _orders(readers.read_any(t.spark, path))


@query("src_06_json_lines", """
SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def json_lines(t):
    path = shared_folder(t.spark, "json")
    writers.write_json(t.events.select("event_id", "event_type", "value", F.from_json("props", "k bigint").alias("props")), path)
    return readers.read_json(t.spark, path).select("event_id", "event_type", "value", "`props.k`")


@query("src_10_headers", 'SELECT s_suppkey AS "supplier key", s_name AS "supplier key_1", s_nationkey AS column_3, s_acctbal AS "a b" FROM supplier')
def headers(t):
    path = shared_folder(t.spark, "headers")
    writers.write_csv(t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").toDF("  supplier   key ", "supplier key", " ", "a b"), path)
    df = readers.read_csv(t.spark, path)
    return df.withColumn("supplier key", F.col("supplier key").cast("long")).withColumn("column_3", F.col("column_3").cast("int"))


@query("src_11_shape_gate", """
SELECT 'region' AS name, count(*) > 0 AS passed FROM region UNION ALL SELECT 'one column', FALSE UNION ALL SELECT 'no rows', count(*) > 0 FROM region WHERE r_regionkey < 0""")
def shape_gate(t):
    def passed(df):
        try:
            return readers.check_shape(df) is not None
        except readers.SourceError:
            return False

    cases = {"region": t.region, "one column": t.region.select("r_name"), "no rows": t.region.where("r_regionkey < 0")}
    return t.spark.createDataFrame([(name, passed(df)) for name, df in cases.items()], "name string, passed boolean")


@query("src_16_partitioned_parquet", "SELECT event_id, user_id, value, event_type FROM events")
def partitioned_parquet(t):
    path = shared_folder(t.spark, "sink")
    writers.write_parquet(t.events.select("event_id", "user_id", "value", "event_type"), path, partition_by=["event_type"])
    return readers.read_parquet(t.spark, path).select("event_id", "user_id", "value", "event_type")


@query("san_09_control_names", "SELECT n_nationkey AS \"key\", n_name AS unnamed_1, n_regionkey AS region FROM nation")
def control_names(t):
    df = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    return readers.rename_all(df, readers.clean_control_names(["k\x00ey", "\x07", " region\x1f"]))
