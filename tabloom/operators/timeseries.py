"""Calendar, lag and rolling features, a ridge autoregression and its recursive forecast."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import BLOCKS, SMALL, micros, with_halo
from ..functions.columns import finite, ident, is_string, is_temporal
from ..functions.linear import Fit, least_squares, moments
from ..functions.ordering import running_totals

CALENDAR = ["ts_dayofweek", "ts_month", "ts_day", "ts_is_weekend"]


def detect_time_column(df: DataFrame) -> str | None:
    """First date or timestamp column, or first text column where over 80 % of the values parse."""
    strings = [f.name for f in df.schema.fields if is_string(f.dataType)]
    parsed = {}
    if strings:
        row = df.agg(*[
            (F.count(F.try_to_timestamp(ident(c))) / F.count(ident(c))).alias(f"p{i}") for i, c in enumerate(strings)
        ]).first()
        parsed = {c: row[f"p{i}"] for i, c in enumerate(strings)}
    for f in df.schema.fields:
        if is_temporal(f.dataType) or (parsed.get(f.name) or 0) > 0.8:
            return f.name
    return None


def calendar(c: Column) -> list[Column]:
    """Monday-based weekday, month, day and weekend flag."""
    day = F.weekday(c)
    return [
        day.alias("ts_dayofweek"), F.month(c).alias("ts_month"), F.dayofmonth(c).alias("ts_day"),
        (day >= 5).cast("int").alias("ts_is_weekend"),
    ]


def feature_names(lags: int = 7, windows: Sequence[int] = (3, 7)) -> list[str]:
    rolling = [f"rolling_{k}_{w}" for w in windows for k in ("mean", "std")]
    return CALENDAR + [f"lag_{i}" for i in range(1, lags + 1)] + rolling


def features(
    df: DataFrame, time: str, target: str, by: Sequence[str] = (), tie: Sequence[str] = (), lags: int = 7,
    windows: Sequence[int] = (3, 7), complete: bool = True, blocks: int = BLOCKS, small: int = SMALL,
) -> DataFrame:
    """Lag and rolling features of the series (optionally one series per ``by``).

    Rolling frames cover the rows before the current one.  Windows run per
    (series, time block) with halo rows, so one long series uses many tasks.
    """
    stamped = df.withColumn(time, F.to_timestamp(ident(time)) if is_string(df.schema[time].dataType) else ident(time))
    order = [time, *tie]
    back = max([lags, *windows])
    placed = with_halo(stamped, micros(ident(time)), order, by, back, blocks, small)
    w = W.partitionBy(*[ident(b) for b in by], "_block").orderBy(*[ident(c) for c in order])
    y = finite(target)
    out = [*calendar(ident(time)), *[F.lag(y, i).over(w).alias(f"lag_{i}") for i in range(1, lags + 1)]]
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        out += [
            F.avg(y).over(frame).alias(f"rolling_mean_{n}"),
            F.coalesce(F.stddev_samp(y).over(frame), F.lit(0.0)).alias(f"rolling_std_{n}"),
        ]
    table = placed.select("_halo", *[ident(c) for c in df.columns], *out).where(~F.col("_halo")).drop("_halo")
    return table.dropna(subset=feature_names(lags, windows)) if complete else table


def history(df: DataFrame, time: str, target: str) -> DataFrame:
    return df.select(ident(time).alias("date"), finite(target).alias("actual")).orderBy("date")


def train_cutoff(table: DataFrame, time: str, share: float = 0.8):
    """Last training timestamp (as microseconds): the first ``share`` of the rows in time order."""
    per = table.groupBy(micros(ident(time)).alias("t")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 0
    run = running_totals(per, "t", ["n"])
    return run.where(F.col("cum_n") <= int(total * share)).agg(F.max("t")).first()[0], total


def fit(table: DataFrame, time: str, target: str, names: Sequence[str], alpha: float = 1.0) -> tuple[Fit, DataFrame]:
    """Ridge on the first 80 % of the rows; a one-row table of held-out MAE, RMSE, R2 and residual spread.

    Rows sharing the cut timestamp stay together.
    """
    cut, _ = train_cutoff(table, time)
    early = micros(ident(time)) <= F.lit(cut)
    model = least_squares(moments(table.where(early), [*names, target]), names, target, alpha)
    pred = linear_expr(model)
    held = table.where(~early).select(finite(target).alias("y"), pred.alias("p"))
    mean = held.agg(F.avg("y")).scalar()
    e = F.col("y") - F.col("p")
    report = held.agg(
        F.count("*").alias("test_rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1.0 - F.sum(e * e) / F.sum((F.col("y") - mean) * (F.col("y") - mean))).alias("r2"),
        F.stddev_pop(e).alias("residual_std"),
    )
    return model, report


def linear_expr(model: Fit) -> Column:
    out = F.lit(model.intercept)
    for c, b in zip(model.features, model.coef):
        out = out + F.lit(float(b)) * ident(c).cast("double")
    return out


def forecast(
    df: DataFrame, time: str, target: str, horizon: int = 14, lags: int = 7, windows: Sequence[int] = (3, 7),
    compat: bool = False,
) -> DataFrame:
    """``step, date, forecast, lower_95, upper_95`` for the steps after the last row.

    Needs 20 complete rows.  Each step feeds its prediction back as lag 1 and
    moves the other lags and rolling statistics along; ``compat`` freezes all
    but the calendar and lag 1.
    """
    names = feature_names(lags, windows)
    table = features(df, time, target, lags=lags, windows=windows)
    schema = "step int, date timestamp, forecast double, lower_95 double, upper_95 double"
    if table.limit(20).count() < 20:
        return df.sparkSession.createDataFrame([], schema)
    model, report = fit(table, time, target, names)
    sigma = report.first()["residual_std"] or 0.0
    last = table.orderBy(ident(time).desc()).limit(1).select(ident(time).cast("timestamp").alias("t"), finite(target).alias("y"), *names).first()
    step = median_step(table, time)
    recent = [last["y"]] + [last[f"lag_{i}"] for i in range(1, lags + 1)]
    x = np.array([float(last[c]) for c in names])
    now, rows = last["t"], []
    for k in range(1, horizon + 1):
        now = now + timedelta(microseconds=step)
        if not compat:
            x = _features_at(now, recent, lags, windows)
        y = model.predict(x)
        half = 1.96 * sigma * (1 + 0.05 * k) ** 0.5
        rows.append((k, now, y, y - half, y + half))
        if compat:
            x[:4] = [now.weekday(), now.month, now.day, float(now.weekday() >= 5)]
            x[4] = y
        recent = [y, *recent[:-1]]
    return df.sparkSession.createDataFrame(rows, schema)


def _features_at(when, recent: list[float], lags: int, windows: Sequence[int]) -> np.ndarray:
    out = [when.weekday(), when.month, when.day, float(when.weekday() >= 5), *recent[:lags]]
    for n in windows:
        part = np.array(recent[:n])
        out += [part.mean(), part.std(ddof=1) if len(part) > 1 else 0.0]
    return np.array(out, dtype=float)


def median_step(table: DataFrame, time: str) -> int:
    """Median gap between consecutive rows in microseconds; a day when it is zero or unknown."""
    per = table.groupBy(micros(ident(time)).alias("t")).agg(F.count("*").alias("n"))
    run = running_totals(per, "t", ["n"])
    gaps = run.select(
        F.explode(F.array(
            F.struct((F.col("next_t") - F.col("t")).alias("gap"), F.lit(1).cast("long").alias("n")),
            F.struct(F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("n")),
        )).alias("g")
    ).select("g.*").where("gap is not null and n > 0")
    counts = gaps.groupBy("gap").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return 86_400_000_000
    ranked = running_totals(counts, "gap", ["n"])
    lo, hi = (total - 1) // 2, total // 2
    row = ranked.agg(
        F.min(F.when(F.col("cum_n") > lo, F.col("gap"))).alias("a"), F.min(F.when(F.col("cum_n") > hi, F.col("gap"))).alias("b")
    ).first()
    return int((row["a"] + row["b"]) / 2) or 86_400_000_000


