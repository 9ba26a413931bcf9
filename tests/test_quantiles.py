"""Quantiles of columns side by side."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import quantiles
from tabloom.functions.columns import long_form


def test_wide_quantiles_equal_long_ones(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=30_000), "b": rng.integers(0, 9, 30_000) * 1.0, "c": np.where(rng.random(30_000) < 0.5, np.nan, rng.random(30_000))})
    df, probs = spark.createDataFrame(pdf), [0.0, 0.01, 0.5, 0.50001, 0.9, 1.0]
    found = quantiles.quantile_map(df, list("abc"), probs)
    assert found == {r["column"]: list(r["quantiles"]) for r in quantiles.long_quantiles(long_form(df, list("abc")), probs).collect()}
    assert found["a"] == pytest.approx(list(np.quantile(pdf["a"], probs)))
    # side by side, no row is told apart by the name of its column
    assert quantiles.wide_quantiles(df, [F.col("a"), F.lit(None).cast("double")], [0.5])[1] == (0, [])
