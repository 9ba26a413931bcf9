"""Table readers on top of ``spark.read``.

Every path may be a local folder, HDFS or an object store URI (``s3a://``,
``gs://``, ``abfss://``): only the Hadoop configuration differs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ident, present
from ..functions.names import number_repeats

# Candidate delimiters, in order of preference.
DELIMITERS = [",", ";", "\t", "|"]

_IDENTIFIER = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", re.ASCII)
_PASSWORD = re.compile(r"(://[^:@/]+:)[^@]+(?=@)")


class SourceError(ValueError):
    """The input cannot be read as a table fit for analysis."""


class Layout(NamedTuple):
    sep: str
    encoding: str


def pick_delimiter(lines: DataFrame) -> str:
    """The delimiter of a table of lines (``value``): on every line, and steadiest, then most frequent."""
    return _layout(lines).sep


def layout(spark: SparkSession, path: str) -> Layout:
    """Delimiter and encoding of a delimited text, both from one aggregate over all of its lines that are not blank."""
    return _layout(spark.read.text(path).where(F.length(F.trim("value")) > 0))


def _layout(lines: DataFrame) -> Layout:
    """A candidate with the same count on every line weighs ten times its count, another its mean.

    Where no candidate is on every line, the one on most lines is taken. The text is UTF-8 if every line is valid, else
    Latin-1 (which always decodes).
    """
    times = [F.length("value") - F.length(F.replace("value", F.lit(d), F.lit(""))) for d in DELIMITERS]
    aggs = [f(n).alias(f"{kind}{i}") for i, n in enumerate(times) for kind, f in (("least", F.min), ("most", F.max), ("mean", F.avg))]
    aggs += [F.count_if(n > 0).alias(f"lines{i}") for i, n in enumerate(times)]
    s = lines.agg(*aggs, F.count_if(~F.is_valid_utf8("value")).alias("broken")).first()
    ranks = []
    for i in range(len(DELIMITERS)):
        steady = s[f"least{i}"] == s[f"most{i}"]
        weight = (s[f"least{i}"] * 10.0 if steady else s[f"mean{i}"]) if s[f"least{i}"] else 0.0
        ranks.append((weight, s[f"lines{i}"], s[f"mean{i}"] or 0.0))
    return Layout(DELIMITERS[ranks.index(max(ranks))], "ISO-8859-1" if s["broken"] else "UTF-8")


def clean_headers(names: Sequence[str | None]) -> list[str]:
    """Collapse whitespace, name blanks ``column_<i>`` and number repeated names."""
    return number_repeats([" ".join((n or "").split()) or f"column_{i}" for i, n in enumerate(names, 1)])


def clean_control_names(names: Sequence[str]) -> list[str]:
    """Names without control characters; blank ones become ``unnamed_<i>``."""
    kept = [re.sub(r"[\x00-\x1f\x7f]", "", str(n)).strip() for n in names]
    return [n or f"unnamed_{i}" for i, n in enumerate(kept)]


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str | None]:
    raw = (
        spark.read.csv(path, sep=sep, header=False, encoding=encoding, ignoreLeadingWhiteSpace=False).limit(1).collect()
    )
    if not raw:
        raise SourceError(f"{path} is empty")
    first = list(raw[0])
    first[0] = (first[0] or "").lstrip("\ufeff")
    return first


def read_csv(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
    schema: T.StructType | None = None, check: bool = True,
) -> DataFrame:
    """Delimited text with sniffed delimiter and encoding.

    Short rows are filled with NULL; rows with too many fields, or with a field of another type, are dropped.
    """
    if not (encoding and sep):
        found = layout(spark, path)
        encoding, sep = encoding or found.encoding, sep or found.sep
    names = clean_headers(_header(spark, path, sep, encoding))
    if schema is None:
        inferred = spark.read.csv(path, sep=sep, header=True, encoding=encoding, inferSchema=True).schema
        schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, inferred.fields)])
    lines = _fields(spark, path, schema, sep, encoding)
    df = lines.where(_fits(schema)).select(*[_typed(f).alias(f.name) for f in schema.fields])
    return check_shape(df) if check else df


CORRUPT, BEYOND = "_corrupt_record", "_beyond"


def _fields(spark: SparkSession, path: str, schema: T.StructType, sep: str, encoding: str) -> DataFrame:
    """The fields of each line as text: missing ones are NULL, the first one too many is in BEYOND."""
    names = [f.name for f in schema.fields] + [BEYOND, CORRUPT]
    wide = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, schema=wide, sep=sep, header=True, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def _typed(field: T.StructField):
    return ident(field.name).try_cast(field.dataType)


def _fits(schema: T.StructType):
    """No field too many, and every field that is there reads as its type."""
    ok = F.col(BEYOND).isNull()
    for f in schema.fields:
        ok = ok & (ident(f.name).isNull() | _typed(f).isNotNull())
    return ok


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def malformed_rows(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """The lines that do not fit ``schema`` (what ``read_csv`` leaves out); short lines do fit."""
    lines = _fields(spark, path, schema, sep, encoding)
    raw = F.coalesce(CORRUPT, F.concat_ws(sep, *[F.coalesce(ident(n), F.lit("")) for n in [*(f.name for f in schema.fields), BEYOND]]))
    return lines.where(~_fits(schema)).select(raw.alias("line"))


def read_parquet(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.toDF(*clean_headers(df.columns))
    return check_shape(df) if check else df


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns to ``parent.child`` columns, level by level."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        out = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += [ident(f.name).getField(s.name).alias(f"{f.name}.{s.name}") for s in f.dataType.fields]
            else:
                out.append(ident(f.name))
        df = df.select(*out)
    return df


def read_json(spark: SparkSession, path: str, lines: bool | None = None, check: bool = True) -> DataFrame:
    """JSON lines, an array of records, or one object, optionally wrapped as ``data`` or ``records``.

    Unless told, one scan decides: several lines that all look like objects are JSON lines.
    """
    if lines is None:
        text = F.trim("value")
        s = spark.read.text(path).where(F.length(text) > 0).agg(F.count("*").alias("n"), F.bool_and(text.startswith("{") & text.endswith("}")).alias("each")).first()
        lines = s["n"] > 1 and s["each"]
    df = spark.read.json(path, multiLine=not lines)
    for wrapper in ("data", "records"):
        kind = df.schema[wrapper].dataType if wrapper in df.columns else None
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and not lines:
            df = df.select(F.explode(wrapper).alias("r")).select("r.*")
            break
    df = flatten(df)
    df = df.toDF(*clean_headers(df.columns))
    return check_shape(df) if check else df


def checked_identifier(name: str) -> str:
    """A bare or schema-qualified table name, nothing else."""
    name = name.strip()
    if not _IDENTIFIER.fullmatch(name):
        raise SourceError(f"invalid table name {name!r}")
    return name


def redact(url: str) -> str:
    return _PASSWORD.sub(r"\1***", url)


def jdbc_options(url: str, query: str = "", table: str = "", limit: int | None = None) -> dict[str, str]:
    """Reader options for a query (wrapped, trailing semicolons cut) or a checked table name."""
    query = re.sub(r"[\s;]+$", "", query)
    if not url.strip():
        raise SourceError("a connection URL is required")
    if query:
        sql = f"SELECT * FROM ({query}) q"
    elif table.strip():
        sql = f"SELECT * FROM {checked_identifier(table)}"
    else:
        raise SourceError("give a query or a table name")
    if limit is None and not query:
        return {"url": url, "dbtable": checked_identifier(table)}
    return {"url": url, "query": sql + (f" LIMIT {int(limit)}" if limit else "")}


def read_jdbc(
    spark: SparkSession, url: str, query: str = "", table: str = "", limit: int | None = None,
    partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 64, **options: str,
) -> DataFrame:
    """Database read; with ``partition_column`` and ``bounds`` the executors read ranges in parallel."""
    opts = {**jdbc_options(url, query, table, limit), **options}
    if partition_column and bounds:
        if "query" in opts:
            opts["dbtable"] = f"({opts.pop('query')}) p"
        opts |= {
            "partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    try:
        df = spark.read.format("jdbc").options(**opts).load()
    except Exception as e:
        raise SourceError(f"database read failed: {redact(str(e))}") from None
    return check_shape(df.toDF(*clean_control_names(df.columns)))


def read_warehouse(spark: SparkSession, connector: str, **options: str) -> DataFrame:
    """A warehouse table or query through its Spark connector (``bigquery``, ``snowflake``)."""
    if connector not in ("bigquery", "snowflake"):
        raise SourceError(f"unknown connector {connector!r}")
    return check_shape(spark.read.format(connector).options(**options).load())


def object_uri(store: str, bucket: str, key: str, account: str = "") -> str:
    """URI of an object for the Hadoop file systems: s3, gcs or azure."""
    bucket, key = bucket.strip(), key.strip().lstrip("/")
    if not bucket or not key:
        raise SourceError("bucket and key are required")
    if store == "s3":
        return f"s3a://{bucket}/{key}"
    if store == "gcs":
        return f"gs://{bucket}/{key}"
    if store == "azure":
        return f"abfss://{bucket}@{account}.dfs.core.windows.net/{key}"
    raise SourceError(f"unknown store {store!r}")


def read_object(spark: SparkSession, store: str, bucket: str, key: str, account: str = "", **options) -> DataFrame:
    return read_csv(spark, object_uri(store, bucket, key, account), **options)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Pick the reader by file extension."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "txt": read_csv, "tsv": read_tsv, "parquet": read_parquet, "json": read_json, "jsonl": read_json}
    if ext not in readers:
        raise SourceError(f"unsupported file type {ext!r}")
    return readers[ext](spark, path)


def check_shape(df: DataFrame) -> DataFrame:
    """At least one row and two columns."""
    if len(df.columns) < 2:
        raise SourceError(f"the table has {len(df.columns)} column(s), two are needed")
    if df.isEmpty():
        raise SourceError("the table has no rows")
    return df


def check_target(df: DataFrame, target: str, min_filled: int = 10) -> DataFrame:
    """``target, filled, usable``: usable when at least ``min_filled`` values are present."""
    if target not in df.columns:
        raise SourceError(f"no column {target!r}; there are {df.columns[:10]}")
    filled = F.count(F.when(present(df, target), 1))
    return df.agg(F.lit(target).alias("target"), filled.alias("filled"), (filled >= min_filled).alias("usable"))
