import numpy as np
import pandas as pd

from canvass.operators.distribution import box_stats, histogram


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.gamma(2.0, 3.0, 2000), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    for bins in (7, 35, 50):
        got = histogram(df, "x", bins).orderBy("bin").toPandas()
        counts, edges = np.histogram(x, bins=bins)
        assert got["count"].tolist() == counts.tolist()
        assert np.allclose(got["lo_edge"], edges[:-1])
        assert np.allclose(got["hi_edge"], edges[1:])


def test_histogram_constant_and_groups(spark):
    df = spark.createDataFrame([("a", 3.0)] * 4 + [("b", 1.0), ("b", 2.0)], "g string, x double")
    got = histogram(df, "x", 4, by="g").orderBy("g", "bin").toPandas()
    a = got[got.g == "a"]
    counts, edges = np.histogram([3.0] * 4, bins=4)
    assert a["count"].tolist() == counts.tolist()
    assert np.allclose(a["lo_edge"], edges[:-1])
    assert got[got.g == "b"]["count"].sum() == 2


def test_box_stats_rules(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 50.0, -30.0]
    df = spark.createDataFrame([("s", v) for v in vals], "g string, x double")
    r = box_stats(df, "x", "g").first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    iqr = q3 - q1
    inside = [v for v in vals if q1 - 1.5 * iqr <= v <= q3 + 1.5 * iqr]
    assert (r["q1"], r["median"], r["q3"]) == (q1, med, q3)
    assert r["whisker_low"] == min(inside) and r["whisker_high"] == max(inside)
    assert (r["n_out_low"], r["n_out_high"]) == (1, 1)
