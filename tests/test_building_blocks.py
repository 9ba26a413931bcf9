"""Distributed building blocks against brute force, with thresholds set so that the large-data paths run."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import association, ordering, pvalues, quantiles, skew
from tabloom.functions.hashing import poisson_one, uniform
from tabloom.functions.linear import least_squares, moments
from tabloom.operators import asof, timeseries


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(4000) < 0.6, 0, rng.integers(1, 1500, 4000))
    x = np.round(rng.normal(size=4000), 2)
    x[:1300] = 0.5
    return pd.DataFrame({"g": g, "x": x})


def test_quantiles_by_data_dependent_groups(spark, numbers):
    df = spark.createDataFrame(numbers).repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in quantiles.long_quantiles(df.withColumnRenamed("x", "value"), probs, ["g"], few_groups=False).collect()}
    for g, part in numbers.groupby("g"):
        assert got[g] == pytest.approx(list(np.quantile(part.x, probs)), abs=1e-12)


def test_quantiles_with_coarse_sketch(spark):
    x = np.random.default_rng(3).exponential(size=20000)
    df = spark.createDataFrame(pd.DataFrame({"column": "x", "value": x})).repartition(5)
    probs = [0.01, 0.333, 0.5, 0.95, 0.99]
    got = quantiles.long_quantiles(df, probs, accuracy=50).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile(x, probs)), abs=1e-12)


def test_running_totals_over_buckets(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"column": np.repeat(["a", "b"], 3000), "v": np.concatenate([rng.permutation(3000), rng.permutation(3000)]).astype(float), "n": rng.integers(1, 9, 6000)})
    got = ordering.running_totals(spark.createDataFrame(pdf), "v", ["n"], by=["column"], buckets=16, small=100).toPandas().sort_values(["column", "v"])
    want = pdf.sort_values(["column", "v"])
    assert (got.cum_n.to_numpy() == want.groupby("column").n.cumsum().to_numpy()).all()
    assert got.next_v.isna().sum() == 2
    assert np.nanmax(np.abs(got.next_v - got.v - 1.0)) == 0


def test_hot_key_join_keeps_all_rows(spark):
    left = spark.range(6000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    out = skew.join_hot_keys(left, right, ["k"], "n", hot_parts=20)
    assert out.count() == 6000 and out.where("k = 0 and n = 3000").count() == 3000


def test_spearman_with_hot_ties(spark, numbers):
    y = numbers.x * 2 + np.random.default_rng(2).normal(size=len(numbers)).round(1)
    pdf = pd.DataFrame({"column": "p", "x": numbers.x, "y": y})
    got = association.spearman(spark.createDataFrame(pdf)).first()["spearman"]
    assert got == pytest.approx(pdf.x.rank().corr(pdf.y.rank()), abs=1e-10)


def test_tail_probabilities():
    assert pvalues.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert pvalues.f_upper(4.965, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert pvalues.chi2_upper(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert pvalues.chi2_upper(2.0, 2) == pytest.approx(math.exp(-1.0), abs=1e-12)
    assert pvalues.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert pvalues.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_kolmogorov_p(spark):
    df = spark.createDataFrame([(1.36 / math.sqrt(500), 1000, 1000)], "d double, a long, b long")
    assert df.select(pvalues.kolmogorov_p(F.col("d"), F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.0494, abs=1e-3)


def test_hash_draws_do_not_depend_on_partitioning(spark):
    def draws(df):
        return sorted(tuple(r) for r in df.select("id", uniform("id"), poisson_one("id")).collect())
    base = spark.range(3000)
    assert draws(base.repartition(3)) == draws(base.repartition(11))
    s = base.agg(F.avg(uniform("id")), F.avg(poisson_one("id"))).first()
    assert s[0] == pytest.approx(0.5, abs=0.03) and s[1] == pytest.approx(1.0, abs=0.07)


def test_ridge_from_moments(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) * [1, 10, 0.1] + 5
    y = x @ [2.0, -1.0, 3.0] + rng.normal(size=500)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(y=y)
    fit = least_squares(moments(spark.createDataFrame(pdf), ["a", "b", "c", "y"]), ["a", "b", "c"], "y", alpha=4.0)
    xc, yc = x - x.mean(0), y - y.mean()
    assert fit.coef == pytest.approx(np.linalg.solve(xc.T @ xc + 4 * np.eye(3), xc.T @ yc), abs=1e-8)
    assert fit.sse == pytest.approx(float(((yc - xc @ fit.coef) ** 2).sum()), rel=1e-8)


def test_asof_in_blocks_equals_pandas(spark):
    rng = np.random.default_rng(9)
    t0 = pd.Timestamp("2024-01-01")
    ev = pd.DataFrame({"u": np.where(rng.random(600) < 0.5, 0, rng.integers(1, 20, 600)), "t": t0 + pd.to_timedelta(rng.permutation(600) * 61, unit="s"), "id": range(600)})
    ft = pd.DataFrame({"u": np.where(rng.random(300) < 0.5, 0, rng.integers(1, 20, 300)), "ft": t0 + pd.to_timedelta(rng.permutation(300) * 120, unit="s"), "f": range(300)})
    got = asof.asof_join(spark.createDataFrame(ev), spark.createDataFrame(ft), "u", "t", "ft", blocks=32, small=0).toPandas().set_index("id").sort_index()
    want = pd.merge_asof(ev.sort_values("t"), ft.sort_values("ft"), by="u", left_on="t", right_on="ft").set_index("id").sort_index()
    assert got.f.fillna(-1).tolist() == want.f.fillna(-1).tolist()


def test_lag_features_in_blocks_equal_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"d": pd.date_range("2024-01-01", periods=400, freq="h"), "y": rng.normal(size=400).round(3)})
    got = timeseries.features(spark.createDataFrame(pdf), "d", "y", blocks=64, small=0).toPandas().sort_values("d")
    lagged = pdf.y.shift(1)
    want = pdf.assign(l7=pdf.y.shift(7), m3=lagged.rolling(3, min_periods=1).mean(), s7=lagged.rolling(7, min_periods=1).std().fillna(0)).dropna()
    assert len(got) == 393
    assert got.lag_7.tolist() == pytest.approx(want.l7.tolist())
    assert got.rolling_mean_3.tolist() == pytest.approx(want.m3.tolist())
    assert got.rolling_std_7.tolist() == pytest.approx(want.s7.tolist())
    assert got.ts_dayofweek.tolist() == want.d.dt.dayofweek.tolist()


def test_forecast_follows_a_line(spark):
    pdf = pd.DataFrame({"d": pd.date_range("2024-01-01", periods=120), "y": np.arange(120) * 2.0 + 5})
    f = timeseries.forecast(spark.createDataFrame(pdf), "d", "y", 5).toPandas()
    assert f.date.iloc[0] == pd.Timestamp("2024-04-30") and f.forecast.iloc[-1] == pytest.approx(253, abs=3)
    assert (f.lower_95 <= f.forecast).all() and len(timeseries.forecast(spark.createDataFrame(pdf), "d", "y", 5, compat=True).collect()) == 5
