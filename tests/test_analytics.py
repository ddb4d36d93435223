from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verispark.operators import analytics as an


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 1200
    return pd.DataFrame({
        "id": np.arange(n), "model": np.where(rng.random(n) < 0.6, "A", "B"), "claim_id": rng.integers(0, 500, n), "created_at": rng.permutation(n),
        "is_correct": rng.integers(0, 2, n), "time_thought": (rng.gamma(2, 3, n)).round(2), "total_tokens": rng.integers(100, 900, n),
        "model_label": rng.integers(0, 5, n).astype(str), "original_label": rng.integers(0, 4, n).astype(str)})


def test_stabilization(spark, data):
    got = {r.model: r.stable_from for r in an.stabilization_point(spark.createDataFrame(data), ["created_at"]).collect()}
    for model, grp in data.sort_values("created_at").groupby("model"):
        right = grp.is_correct.to_numpy()
        running = right.cumsum() / np.arange(1, len(right) + 1)
        outside = [place for place, share in enumerate(running, 1) if abs(share - right.mean()) > 0.01]
        first = max(outside, default=0) + 1
        assert got[model] == (first if first <= len(right) else None)


def test_rolling_accuracy(spark, data):
    out = an.rolling_accuracy(spark.createDataFrame(data), ["claim_id", "id"]).toPandas().sort_values(["model", "claim_id", "id"])
    want = data.sort_values(["model", "claim_id", "id"]).groupby("model").is_correct.rolling(300, center=True, min_periods=50).mean() * 100
    np.testing.assert_allclose(out.rolling_acc.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_box(spark, data):
    got = {r.model: r for r in an.box_stats(spark.createDataFrame(data), ["model"], "time_thought").collect()}
    for model, grp in data.groupby("model"):
        q1, q3 = grp.time_thought.quantile([0.25, 0.75])
        inside = grp.time_thought[(grp.time_thought >= q1 - 1.5 * (q3 - q1)) & (grp.time_thought <= q3 + 1.5 * (q3 - q1))]
        r = got[model]
        assert (r.q1, r.q3, r.whisker_low, r.whisker_high) == pytest.approx((q1, q3, inside.min(), inside.max()))


def test_histogram(spark, data):
    rows = an.histogram_bins(spark.createDataFrame(data), ["model"], "total_tokens", 30).toPandas()
    for model, grp in data.groupby("model"):
        want, _ = np.histogram(grp.total_tokens, bins=30)
        assert rows[rows.model == model].sort_values("bin").n.tolist() == want.tolist()
    flat = an.histogram_bins(spark.createDataFrame([("m", 2.0), ("m", 2.0)], "model string, x double"), ["model"], "x", 4).orderBy("bin").collect()
    assert [r.n for r in flat] == [0, 0, 2, 0]


def test_efficiency_has_the_whole_number_division(spark):
    df = spark.createDataFrame(
        [("a", "m", 1, 10, 6, 4, 1.0), ("a", "m", 1, 11, 6, 5, 2.0), ("b", "m", 0, 5, 3, 2, 1.0)],
        "agent_name string, model_name string, is_correct int, total_tokens int, prompt_tokens int, completion_tokens int, time_thought double")
    got = {r.agent_name: r for r in an.efficiency_table(df).collect()}
    assert got["a"].tokens_per_correct == 10.0 and got["b"].tokens_per_correct is None
    assert {r.agent_name: r.tokens_per_correct for r in an.efficiency_table(df, compat=False).collect()}["a"] == 10.5


@pytest.mark.parametrize(
    ("topic", "wide", "narrow"),
    [("R.13", "R (kod egzaminu)", "R (exam code)"), ("m.XX", "M (kod egzaminu)", "m.XX"), ("Fizyka", "Fizyka", "Fizyka"), ("M.YY.1", "M (kod egzaminu)", "M.YY.1"), ("Fiz. 1", "Fiz. 1", "Fiz. 1")],
)
def test_families(one, topic, wide, narrow):
    assert one(an.topic_family(F.col("t")), t=topic) == wide
    assert one(an.topic_family(F.col("t"), " (exam code)", placeholders=False), t=topic) == narrow


def test_categories(spark):
    df = spark.createDataFrame([("0", "2015"), ("2", "n/a"), ("2", "2015"), ("x", None)], "label_original string, claim_date string")
    got = {(r.kind, r.category): r.n for r in an.category_counts(df).collect()}
    assert got == {("answer", "A (0)"): 1, ("answer", "B (1)"): None, ("answer", "C (2)"): 2, ("answer", "D (3)"): None, ("year", "2015"): 2}


def test_shares(spark):
    full = spark.createDataFrame([("a",)] * 3 + [("b",)], "t string")
    sub = spark.createDataFrame([("c",), ("a",)], "t string")
    got = {r.category: (r.full_pct, r.subset_pct) for r in an.share_compare(sub, full, F.col("t")).collect()}
    assert got == {"a": (75.0, 50.0), "b": (25.0, 0.0), "c": (0.0, 50.0)}


def test_dims(spark):
    df = spark.createDataFrame([("uam_ga6__x", "hf/Bielik"), ("other", "z")], "agent_name string, model_name string")
    rows = an.label_dims(df, [("Bielik", "Bielik-11B")], "llama").orderBy("agent_name").collect()
    assert [(r.model, r.base_agent, r.label, r.tier) for r in rows] == [("llama", None, None, 0), ("Bielik-11B", "uam_ga6", "ga6\nDebate", 3)]
