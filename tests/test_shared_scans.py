"""Euclidean silhouette, shared-scan k-means, sketches and partial states."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.operators import cluster, crosstab, lloyd, profile, select, silhouette, sketch, states
from canvass.sources.schema import PAIN_COLS


def blobs(spark, n=400, k=4, dim=5, seed=0, spread=0.6):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(k, dim)) * 3
    x = middle[r.integers(k, size=n)] + r.normal(size=(n, dim)) * spread
    names = [f"f{i}" for i in range(dim)]
    return x, names, spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "respondent_id long, " + ", ".join(f"{c} double" for c in names))


# --- silhouette ----------------------------------------------------------------
def brute_silhouette(x, c, asked):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = {}
    for i in asked:
        own = (c == c[i]).sum()
        others = [d[i, c == o].mean() for o in set(c.tolist()) - {c[i]}]
        a = d[i, c == c[i]].sum() / (own - 1) if own > 1 else None
        out[i] = 0.0 if a is None or not others or max(a, min(others)) == 0 else (min(others) - a) / max(a, min(others))
    return out


@pytest.mark.parametrize("rows, asked_rows", [(8192, 512), (50, 7)])
def test_silhouette_is_that_of_all_pairs(spark, monkeypatch, rows, asked_rows):
    monkeypatch.setattr(silhouette, "BLOCK_ROWS", rows)
    monkeypatch.setattr(silhouette, "ASKED_ROWS", asked_rows)
    r = np.random.default_rng(1)
    x, c = np.r_[r.normal(size=(300, 6)) + 1e4, np.zeros((5, 6)) + 1e4], np.r_[r.integers(0, 4, 300), [0, 0, 1, 7, 7]]
    x[:40] = x[40:80]  # equal points
    points = spark.createDataFrame([(i, int(k), [float(v) for v in p]) for i, (k, p) in enumerate(zip(c, x))], "point_id long, cluster int, vec array<double>")
    for every in (1, 7):
        got = {q.id: q.silhouette for q in silhouette.silhouette_points(points, every=every).collect()}
        assert got == pytest.approx(brute_silhouette(x, c, range(0, len(x), every)), abs=1e-7)


def test_silhouette_edges(spark):
    schema = "point_id long, cluster int, vec array<double>"
    rows = [(0, 1, [1.0]), (50, 2, [2.0]), (100, 2, [2.0]), (150, None, [1.0]), (200, 1, None), (None, 1, [1.0])]
    got = {r.id: r.silhouette for r in silhouette.silhouette_points(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: 0.0, 50: 1.0, 100: 1.0}
    assert silhouette.silhouette_euclidean(spark.createDataFrame([], schema)).count() == 0
    one = silhouette.silhouette_euclidean(spark.createDataFrame([(0, 1, [1.0]), (50, 1, [3.0])], schema)).first()
    assert (one.silhouette, one.n_asked) == (0.0, 2)


# --- k-means -------------------------------------------------------------------
def lloyd_alone(x, centers, tol, max_iter=300):
    costs = []
    for _ in range(max_iter):
        d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
        costs.append(d.min(axis=1).sum())
        best = d.argmin(axis=1)
        moved = np.array([x[best == j].mean(axis=0) if (best == j).any() else centers[j] for j in range(len(centers))])
        shift, centers = ((moved - centers) ** 2).sum(), moved
        if shift <= tol:
            break
    d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    return d.min(axis=1).sum(), len(costs), sorted(np.bincount(d.argmin(axis=1), minlength=len(centers)).tolist(), reverse=True)


def test_models_in_shared_scans_are_those_alone(spark):
    x, names, df = blobs(spark)
    fits = lloyd.fit_models(df, names, [2, 4, 6], [1, 2], rel_tol=1e-4)
    sample = lloyd.start_sample(df, names, "respondent_id", 400)
    assert sorted(map(tuple, sample)) == sorted(map(tuple, x)) and len(fits) == 6
    for f in fits:
        cost, iterations, sizes = lloyd_alone(x, lloyd.plus_plus(sample, f.k, f.seed), 1e-4 * x.var(axis=0).mean())
        assert (f.iterations, f.sizes, f.settled) == (iterations, sizes, True) and f.cost == pytest.approx(cost)
        assert all(b <= a * (1 + 1e-12) for a, b in zip(f.path, f.path[1:]))
    best = lloyd.best_by_k(fits)
    assert best[4].cost == min(f.cost for f in fits if f.k == 4) and best[2].cost > best[4].cost > best[6].cost
    counts = cluster.assign(best[4], df).groupBy("cluster").count().orderBy("cluster").collect()
    assert [r["count"] for r in counts] == best[4].sizes
    assert [r["cluster"] for r in cluster.centroids(best[4], names).collect()] == [0, 1, 2, 3]


def test_models_do_not_depend_on_the_layout(spark):
    _, names, df = blobs(spark, 300)
    a, b = (lloyd.fit_models(d, names, [3], [5])[0] for d in (df.coalesce(1), df.repartition(9, "f0")))
    assert a.sizes == b.sizes and a.cost == pytest.approx(b.cost, rel=1e-12)


def test_odd_inputs_of_k_means(spark):
    schema = "respondent_id long, f0 double"
    two = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 5.0)], schema)
    fit = lloyd.fit_models(two, ["f0"], [4], [1])[0]  # more clusters than points
    assert fit.cost == 0.0 and sum(fit.sizes) == 3
    same = lloyd.fit_models(spark.createDataFrame([(k, 1.0) for k in range(9)], schema), ["f0"], [2], [1])[0]
    assert same.cost == 0.0 and same.sizes[0] == 9
    assert lloyd.fit_models(two, ["f0"], [2], [1], max_iter=1)[0].iterations == 1
    with pytest.raises(ValueError):
        lloyd.fit_models(two.where("false"), ["f0"], [2], [1])


# --- sketches ------------------------------------------------------------------
def test_sketched_quantiles_are_near_the_rank(spark):
    r = np.random.default_rng(2)
    rows = [(i % 3, float(v)) for i, v in enumerate(r.lognormal(size=60_000))] + [(0, None), (0, float("nan")), (None, 1.0), (7, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    found = sketch.approx_quantiles(df, ["v"], [0.0, 0.01, 0.5, 0.99, 1.0], ["g"])
    errors = sketch.rank_errors(df, found, ["v"], ["g"]).collect()
    assert len(errors) == 15 and {e.n for e in errors} == {20_000} and max(e.error for e in errors) <= sketch.RANK_ERROR
    parts = sketch.sketches(df.withColumn("h", F.col("v") > 1), ["v"], ["g", "h"])
    merged = sketch.quantiles_of(sketch.merged(parts), [0.5])
    assert sketch.rank_errors(df.where("g is not null"), merged, ["v"]).first().error <= sketch.RANK_ERROR


# --- partial states ------------------------------------------------------------
def test_every_selection_rolls_up_to_the_direct_result(spark, responses_small):
    df = responses_small.withColumns({
        "segment": F.when(F.col("segment") != "MACHINERY", F.col("segment")),
        "hvac_pct_of_bill": F.when(F.col("respondent_id") % 9 == 0, float("nan")).otherwise(F.col("hvac_pct_of_bill"))}).cache()
    table = states.partial_states(df).cache()
    segments, emirates = ([r[0] for r in df.select(c).distinct().orderBy(c).collect()] for c in ("segment", "primary_emirate"))
    picks = [p for n in (1, 2, len(segments)) for p in itertools.combinations(segments, n)][::3]
    exact = ["respondents", "n_high_intent", "n_evaluator", "n_pilot", "high_intent_pct", "evaluator_pct", "pilot_pct", "hvac_avg"]
    rows = lambda d, cols: sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in d.collect())
    for k, pick in enumerate(picks):
        chosen = {"segment": list(pick), "primary_emirate": emirates[k % 3:k % 3 + 1 + k % 2] or emirates}
        direct = select.filter_members(df, chosen).cache()
        assert rows(states.kpi_row(table, chosen), exact) == rows(profile.kpi_row(direct), exact)
        assert rows(states.crosstab(table, "primary_emirate", "commercial_model", chosen), ["primary_emirate", "commercial_model", "n", "pct"]) == \
            rows(crosstab.crosstab(direct, "primary_emirate", "commercial_model"), ["primary_emirate", "commercial_model", "n", "pct"])
        assert rows(states.group_means(table, "primary_emirate", PAIN_COLS[:3], chosen, "pain_"), ["primary_emirate", "item", "rate", "label"]) == \
            rows(crosstab.group_means(direct, "primary_emirate", PAIN_COLS[:3], "pain_"), ["primary_emirate", "item", "rate", "label"])
        direct.unpersist()
    assert states.kpi_row(table, {"segment": ["nowhere"]}, "segment").count() == 0
    assert states.partial_states(df.where("false")).where("n > 0").count() == 0


def test_kpi_mean_leaves_nan_out(responses_small):
    df = responses_small.withColumn("hvac_pct_of_bill", F.when(F.col("respondent_id") % 2 == 0, F.lit(4.0)).otherwise(F.lit(float("nan"))))
    assert profile.kpi_row(df).first().hvac_avg == 4.0
