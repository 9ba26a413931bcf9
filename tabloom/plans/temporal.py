"""Point-in-time joins (FS) and time series (TS) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, timeseries as ts
from .registry import query, rounded, sql_rounded


def purchases(t):
    return t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")


def clicks(t):
    c = t.events.where("event_type = 'click'")
    return c.groupBy("user_id", F.col("ts").alias("click_ts")).agg(F.max("event_id").alias("click_id"))


ASOF = """
WITH p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, ts AS click_ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, p.ts, p.value, c.click_ts, c.click_id FROM p ASOF LEFT JOIN c
ON p.user_id = c.user_id AND p.ts >= c.click_ts
"""


@query("fs_01_asof_join", ASOF)
def asof_clicks(t):
    return asof.asof_join(purchases(t), clicks(t), "user_id", "ts", "click_ts")


@query("fs_01_asof_join_ttl", f"""
SELECT event_id, user_id, ts, value, CASE WHEN ts - click_ts <= INTERVAL 1 DAY THEN click_ts END AS click_ts,
 CASE WHEN ts - click_ts <= INTERVAL 1 DAY THEN click_id END AS click_id FROM ({ASOF})""")
def asof_clicks_ttl(t):
    return asof.asof_join(purchases(t), clicks(t), "user_id", "ts", "click_ts", ttl_seconds=86400)


@query("fs_01_asof_join_blocks", ASOF.replace("p.user_id = c.user_id", "p.et = c.et").replace("user_id, ts, value FROM", "user_id, ts, value, 1 AS et FROM").replace("SELECT user_id, ts AS click_ts", "SELECT 1 AS et, ts AS click_ts"))
def asof_one_hot_entity(t):
    """All rows share one entity: the join still runs in many time blocks."""
    p = purchases(t).withColumn("et", F.lit(1))
    c = clicks(t).groupBy(F.lit(1).alias("et"), "click_ts").agg(F.max("click_id").alias("click_id"))
    return asof.asof_join(p, c, "et", "ts", "click_ts", small=0).drop("et")


def daily(t):
    return t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )


DAILY = "SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1"


@query("ts_01_detect_time_column", """
SELECT 'ts' AS time_column, 'o_orderdate' AS orders_column, count(*) AS rows FROM events""")
def detect(t):
    return t.events.agg(
        F.lit(ts.detect_time_column(t.events)).alias("time_column"),
        F.lit(ts.detect_time_column(t.orders)).alias("orders_column"), F.count("*").alias("rows"),
    )


def _ts_sql(source: str, by: str, time: str, y: str, keep: str, keyset: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    w = f"({part}ORDER BY {keyset}"
    lags = ", ".join(f"lag({y}, {i}) OVER {w}) AS lag_{i}" for i in range(1, 8))
    rolls = ", ".join(
        f"avg({y}) OVER {w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS rolling_mean_{n}, "
        f"coalesce(stddev_samp({y}) OVER {w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0.0) AS rolling_std_{n}" for n in (3, 7)
    )
    inner = (
        f"SELECT {keep}, CAST(isodow({time}) - 1 AS INTEGER) AS ts_dayofweek, CAST(month({time}) AS INTEGER) AS ts_month, "
        f"CAST(day({time}) AS INTEGER) AS ts_day, CAST(isodow({time}) >= 6 AS INTEGER) AS ts_is_weekend, {lags}, {rolls} FROM {source}"
    )
    ints = "ts_dayofweek ts_month ts_day ts_is_weekend"
    keep_names = " ".join(k.split(" AS ")[-1].strip() for k in keep.split(","))
    return sql_rounded(
        f"SELECT * FROM ({inner}) WHERE lag_7 IS NOT NULL", f"{keep_names} {ints}".replace(" ", ", ").replace(", ", " "), 3,
        " ".join(f"lag_{i}" for i in range(1, 8)) + " rolling_mean_3 rolling_std_3 rolling_mean_7 rolling_std_7",
    )


@query("ts_02_to_05_features", _ts_sql(f"({DAILY})", "", "day", "revenue", "day, revenue", "day"))
def features(t):
    return rounded(ts.features(daily(t), "day", "revenue"), 3)


@query("ts_03_features_per_series", _ts_sql(
    "events", "event_type", "ts", "value", "event_id, event_type, ts", "ts, event_id"))
def features_by_type(t):
    e = t.events.select("event_id", "event_type", "ts", "value")
    out = ts.features(e, "ts", "value", by=["event_type"], tie=["event_id"], small=0, blocks=16)
    return rounded(out.drop("value"), 3)


@query("ts_06_ridge_fit")
def ridge_fit(t):
    return ts.fit(ts.features(daily(t), "day", "revenue"), "day", "revenue", ts.feature_names())[1]


@query("ts_07_forecast")
def forecast(t):
    return ts.forecast(daily(t), "day", "revenue", 14)


@query("ts_08_history", f"SELECT CAST(day AS DATE) AS date, revenue AS actual FROM ({DAILY})")
def history(t):
    return ts.history(daily(t), "day", "revenue")
