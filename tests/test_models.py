"""Fitted models: invariants, not values."""

import pytest
from pyspark.sql import functions as F

from canvass.operators import cluster, price, propensity
from canvass.sources.schema import CLUSTER_FEATURES


@pytest.fixture(scope="module")
def vectors(responses_small):
    return cluster.with_vector(cluster.scaled_matrix(responses_small), CLUSTER_FEATURES).cache()


def test_scaled_matrix_is_standardised(vectors):
    r = vectors.agg(F.avg("pain_high_cost").alias("m"), F.stddev_pop("pain_high_cost").alias("s")).first()
    assert abs(r["m"]) < 1e-9 and r["s"] == pytest.approx(1.0)


def test_kmeans_best_of_seeds_and_elbow(vectors):
    fit = cluster.kmeans_best(vectors, 3, seeds=[1, 2, 3])
    data = cluster._fit_input(vectors)
    tol = cluster.sklearn_tol(data, 3)
    single = [cluster._fit(data, 3, s, 300, tol)[1] for s in (1, 2, 3)]
    assert fit.cost == pytest.approx(min(single))
    sizes = cluster.assign(fit, vectors).groupBy("cluster").count().orderBy("cluster").collect()
    counts = [r["count"] for r in sizes]
    assert counts == sorted(counts, reverse=True) and sum(counts) == 1500
    curve = [r["inertia"] for r in cluster.elbow(vectors, ks=[2, 4, 6], seeds=[1, 2]).orderBy("k").collect()]
    assert curve[0] > curve[1] > curve[2]


def test_pca_signs_and_ratios(vectors):
    p = cluster.fit_pca(vectors, CLUSTER_FEATURES)
    assert 0 < p.explained[1] <= p.explained[0] < 1
    for w in p.loadings:
        assert max(w, key=abs) > 0


def test_forest_and_boosting_invariants(responses_small):
    rf = propensity.fit_forest(responses_small, num_trees=10, cross_validate=False)
    assert sum(r["importance"] for r in rf.importances.collect()) == pytest.approx(1.0)
    assert rf.test_predictions.count() > 0
    gb = price.fit_boosting(responses_small, rounds=10)
    assert sum(r["importance"] for r in gb.importances.collect()) == pytest.approx(1.0)


def test_silhouette_equals_mllib_evaluator(vectors):
    from pyspark.ml.evaluation import ClusteringEvaluator

    from canvass.operators.evaluate import silhouette_sq_euclidean
    fit = cluster.kmeans_best(vectors, 4, seeds=[5])
    assigned = cluster.assign(fit, vectors)
    ours = silhouette_sq_euclidean(assigned, "cluster", "features").first()["silhouette"]
    ref = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(
        assigned.withColumn("cluster", F.col("cluster").cast("double")))
    assert ours == pytest.approx(ref, rel=1e-9)


def test_cross_validation_scores(responses_small):
    rf = propensity.fit_forest(responses_small, num_trees=8, folds=3, cross_validate=True)
    row = rf.cv_metrics.first()
    assert row["folds"] == 3 and 0.0 < row["cv_macro_f1"] <= 1.0 and row["cv_macro_f1_std"] >= 0.0


def test_forest_beats_the_majority_class_and_boosting_the_mean(responses_small):
    rf = propensity.fit_forest(responses_small, num_trees=30, cross_validate=False)
    rows = rf.test_predictions.groupBy("actual").agg(F.count("*").alias("n")).collect()
    from canvass.operators import evaluate
    f1 = evaluate.macro_f1(rf.test_predictions, "actual", "predicted").first()["macro_f1"]
    total, most = sum(r["n"] for r in rows), max(r["n"] for r in rows)
    majority = 2 * most / (total + most) / len(rows)  # macro F1 of always naming the largest class
    assert f1 > majority
    gb = price.fit_boosting(responses_small, rounds=30)
    assert evaluate.regression_metrics(gb.test_predictions).first()["r2"] > 0.0


def test_one_row_per_input(vectors):
    fit = cluster.kmeans_best(vectors, 3, seeds=[1])
    assigned = cluster.assign(fit, vectors)
    assert assigned.count() == assigned.select("respondent_id").distinct().count() == vectors.count()
    assert {r["cluster_name"] for r in assigned.select("cluster_name").distinct().collect()} == {"Cluster 0", "Cluster 1", "Cluster 2"}
