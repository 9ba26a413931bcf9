"""Column expressions and schema helpers used across operators."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INF = float("inf")


def ident(name: str) -> Column:
    """Reference a column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _as_column(c: str | Column) -> Column:
    return ident(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """``c`` as double with NaN and both infinities turned into NULL.

    Spark orders NaN above every number, so one comparison drops all three.
    """
    value = _as_column(c).cast("double")
    return F.when(F.abs(value) < F.lit(_INF), value)


def not_nan(c: str | Column) -> Column:
    """``c`` as double with NaN turned into NULL (infinities kept)."""
    return F.nanvl(_as_column(c).cast("double"), F.lit(None).cast("double"))


def present(df: DataFrame, name: str) -> Column:
    """NULL-safe "is not missing" test: NaN counts as missing."""
    c = ident(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    """Bound ``c`` to [lo, hi], keeping NULL as NULL (least/greatest skip NULLs)."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def total(columns: Iterable[Column]) -> Column:
    out = None
    for c in columns:
        out = c if out is None else out + c
    return F.lit(0.0) if out is None else out


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_string(f.dataType) and f.name not in skip]


def kind_of(dt: T.DataType) -> str:
    """Coarse dtype family: int, float, string, bool, datetime or other."""
    if isinstance(dt, T.IntegralType):
        return "int"
    if is_numeric(dt):
        return "float"
    if is_string(dt):
        return "string"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if is_temporal(dt):
        return "datetime"
    return "other"


def name_tokens(name: str) -> set[str]:
    return set(re.findall(r"[a-z]+", name.lower()))


def long_form(df: DataFrame, columns: Iterable[str], by: Iterable[str] = (), value=finite) -> DataFrame:
    """Unpivot ``columns`` to (by..., column, value) inside the scan stage, NULLs dropped."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns])
    return (
        df.select(*[ident(b) for b in by], F.explode(entries).alias("_e"))
        .select(*[ident(b) for b in by], F.col("_e.column").alias("column"), F.col("_e.value").alias("value"))
        .where(F.col("value").isNotNull())
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation of the complete pairs; NULL when a side is constant.

    (The built-in aggregate raises a division error there in ANSI mode.)
    """
    a, b = _as_column(x), _as_column(y)
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.least(F.greatest(F.try_divide(F.covar_pop(a, b), spread), F.lit(-1.0)), F.lit(1.0))
