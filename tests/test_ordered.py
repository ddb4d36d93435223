from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verispark.operators import ordered as od


@pytest.fixture(scope="module")
def skewed():
    """One key holds most rows; values repeat a lot."""
    rng = np.random.default_rng(3)
    n = 3000
    return pd.DataFrame({
        "k": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n)), "id": rng.permutation(n),
        "x": rng.integers(0, 40, n) / 8, "v": rng.integers(0, 2, n)})


def test_ordinals_have_no_gaps(spark, skewed):
    got = od.with_ordinal(spark.createDataFrame(skewed), ["id"]).toPandas()
    assert (got.sort_values("id").ordinal.to_numpy() == np.arange(len(skewed))).all()


def test_running_sums(spark, skewed):
    got = od.running_sums(spark.createDataFrame(skewed), ["k"], ["id"], {"s": F.col("v")}).toPandas().sort_values(["k", "id"])
    want = skewed.sort_values(["k", "id"])
    assert (got.pos.to_numpy() == (want.groupby("k").cumcount() + 1).to_numpy()).all()
    assert (got.s.to_numpy() == want.groupby("k").v.cumsum().to_numpy()).all()


def test_previous(spark, skewed):
    got = od.with_previous(spark.createDataFrame(skewed), ["k"], ["id"], ["v"]).select("k", "id", "prev.v").toPandas()
    want = skewed.sort_values(["k", "id"])
    got = got.sort_values(["k", "id"])
    np.testing.assert_array_equal(got.v.to_numpy(dtype=float), want.groupby("k").v.shift().to_numpy(dtype=float))


@pytest.mark.parametrize(("window", "least", "block"), [(300, 50, 20_000), (300, 50, 64), (7, 3, 5), (4, 1, 2)])
def test_rolling_matches_centred_windows(spark, skewed, window, least, block):
    half = window // 2
    out = od.rolling(spark.createDataFrame(skewed), ["k"], ["id"], half, window - half - 1,
                     {"n": F.count("v"), "m": F.percentile("x", 0.5)}, block=block).toPandas().sort_values(["k", "id"])
    want = skewed.sort_values(["k", "id"]).groupby("k").x.rolling(window, center=True, min_periods=least).median()
    got = out.m.where(out.n >= least).to_numpy(dtype=float)
    np.testing.assert_allclose(got, want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("block", [20_000, 64])
def test_rolling_median(spark, skewed, block):
    out = od.rolling_median(spark.createDataFrame(skewed), ["k"], ["id"], "x", 300, 20, "m", block=block).toPandas().sort_values(["k", "id"])
    want = skewed.sort_values(["k", "id"]).groupby("k").x.rolling(300, center=True, min_periods=20).median()
    np.testing.assert_allclose(out.m.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_exact_quantiles(spark, skewed):
    ps = {"q1": 0.25, "med": 0.5, "p99": 0.99, "lo": 0.0, "hi": 1.0}
    got = od.exact_quantiles(spark.createDataFrame(skewed), ["k"], "x", ps).toPandas().set_index("k").sort_index()
    for name, p in ps.items():
        np.testing.assert_allclose(got[name].to_numpy(), skewed.groupby("k").x.quantile(p).sort_index().to_numpy())
    whole = od.exact_quantiles(spark.createDataFrame(skewed), [], "x", {"m": 0.37}).first().m
    assert whole == pytest.approx(skewed.x.quantile(0.37))


def test_keep_first_cuts_before_the_shuffle(spark, skewed):
    df = od.keep_first(spark.createDataFrame(skewed), ["k"], ["id"])
    assert df.count() == skewed.k.nunique()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
