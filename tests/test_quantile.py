import numpy as np
import pandas as pd
import pytest

from canvass.operators.quantile import median_values, quantiles


def _frame(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b", "c", None], n, p=[0.6, 0.25, 0.1, 0.05]),
        "x": rng.lognormal(2, 1.5, n),
        "k": rng.integers(0, 4, n).astype(float),
    })
    pdf.loc[::11, "x"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def _check(pdf, res, col):
    for r in res[res.metric == col].itertuples():
        sub = pdf[pdf.g == r.g][col].dropna()
        assert r.n == len(sub)
        assert r.value == pytest.approx(sub.quantile(r.p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("finish_limit", [10**9, 40])
def test_grouped_quantiles_match_pandas(spark, finish_limit):
    pdf, df = _frame(spark)
    probs = [0.0, 0.25, 0.5, 0.85, 1.0]
    res = quantiles(df, ["x", "k"], probs, "g", finish_limit=finish_limit, buckets=8).toPandas()
    assert set(res.g) == {"a", "b", "c"}  # the null group is dropped
    assert len(res) == 3 * 2 * len(probs)
    _check(pdf, res, "x")
    _check(pdf, res, "k")  # heavy ties: brackets collapse to one value


def test_skewed_group_multi_pass(spark):
    # one group holds almost every row; selection passes must stay exact
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": ["hot"] * 5000 + ["cold"] * 7, "x": rng.normal(0, 1, 5007)})
    df = spark.createDataFrame(pdf)
    res = quantiles(df, ["x"], [0.5, 0.75], "g", finish_limit=100, buckets=4).toPandas()
    _check(pdf, res, "x")


def test_global_median_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,), (2.0,), (10.0,)], "x double")
    assert median_values(df, ["x"])["x"] == pytest.approx(3.0)
    empty = df.where("x > 100")
    assert median_values(empty, ["x"]) == {"x": None}
    assert quantiles(empty, ["x"], [0.5]).count() == 0


def test_single_value_and_constant(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 2.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    res = {r["g"]: r["value"] for r in quantiles(df, ["x"], [0.3], "g").collect()}
    assert res == {"a": 5.0, "b": 2.0}
