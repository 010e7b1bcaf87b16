"""Fitted trees as node tables, and boosting by residuals."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from canvass.operators import evaluate, price, propensity, trees
from canvass.sources.schema import CLASSIFIER_FEATURES, REGRESSION_FEATURES


@pytest.fixture(scope="module")
def forest(responses_small):
    return propensity.fit_forest(responses_small, num_trees=7, cross_validate=False)


@pytest.fixture(scope="module")
def boost(responses_small):
    return price.fit_boosting(responses_small, rounds=9)


@pytest.fixture(scope="module")
def residual(responses_small):
    return price.fit_by_residuals(responses_small, rounds=23)


def test_forest_scored_by_its_table(spark, forest):
    table = trees.of_ensemble(spark, forest.model)
    ours = trees.class_shares(forest.matrix, table, forest.model.numClasses, "respondent_id")
    theirs = forest.model.transform(forest.matrix).select("respondent_id", vector_to_array("probability").alias("p"), F.col("prediction").alias("named"))
    rows = theirs.join(ours, "respondent_id").collect()
    assert len(rows) == forest.matrix.count()
    for r in rows:
        assert r["shares"] == pytest.approx(r["p"], abs=1e-9)
        assert r["shares"][int(r["named"])] == pytest.approx(max(r["shares"]), abs=1e-9)


def test_importances_from_gains(spark, forest, boost):
    for fit, feats, per_tree in ((forest, CLASSIFIER_FEATURES, True), (boost, REGRESSION_FEATURES, False)):
        found = {r["feature"]: r["importance"] for r in trees.importances(trees.of_ensemble(spark, fit.model), feats, per_tree).collect()}
        assert found == pytest.approx({r["feature"]: r["importance"] for r in fit.importances.collect()}, abs=1e-9)


def test_boosting_scored_by_its_table(spark, boost):
    ours = trees.regression_sums(boost.matrix.where("is_test"), trees.of_ensemble(spark, boost.model), "respondent_id")
    both = boost.test_predictions.join(ours.withColumnRenamed("prediction", "ours"), "respondent_id")
    assert both.where(F.abs(F.col("ours") - F.col("prediction")) > 1e-9).count() == 0
    assert both.count() == boost.test_predictions.count() > 0


def test_residual_loop(spark, residual):
    """Across checkpoints too: each round lowers the training error by what shrunken leaf means
    must, and the table of its trees gives the same predictions."""
    assert len(residual.trees) == 23 and len(residual.losses) == 24
    assert all(b < a for a, b in zip(residual.losses, residual.losses[1:]))
    ours = trees.regression_sums(residual.matrix.where("is_test"), trees.of_trees(spark, residual.trees, residual.step, residual.start), "respondent_id")
    both = residual.test_predictions.join(ours.withColumnRenamed("prediction", "ours"), "respondent_id")
    assert both.where(F.abs(F.col("ours") - F.col("prediction")) > 1e-9).count() == 0 and both.count() > 0
    assert evaluate.regression_metrics(residual.test_predictions).first()["r2"] > 0
    # the first round by hand: the leaf means of the first tree on what the mean leaves over
    train = residual.matrix.where("not is_test").withColumn("r", F.col("y") - F.lit(residual.start))
    leaf = residual.trees[0].transform(train.select("features", "y", "r"))
    left = leaf.agg(F.avg(F.pow(F.col("r") - residual.step * F.col("_leaf"), 2))).first()[0]
    assert left == pytest.approx(residual.losses[1], rel=1e-9)


def test_odd_inputs(spark, residual, responses_small):
    table = trees.of_trees(spark, residual.trees[:2], 1.0, 0.0)
    assert trees.leaves(residual.matrix.limit(0), table, "respondent_id").count() == 0
    # a value equal to a threshold goes left
    root = table.nodes.where("tree = 0 and node = 0").first()
    assert root["left"] is not None
    at = F.transform(vector_to_array("features"), lambda v, i: F.when(i == root["feature"], F.lit(root["threshold"])).otherwise(v))
    from pyspark.ml.functions import array_to_vector
    moved = residual.matrix.withColumn("features", array_to_vector(at))
    ours = trees.leaves(moved, table, "respondent_id").where("tree = 0").select("respondent_id", "value")
    theirs = residual.trees[0].transform(moved.select("respondent_id", "features"))
    assert ours.join(theirs, "respondent_id").where("value <> _leaf").count() == 0
    # one target for all: trees without a split, no importance
    flat = price.fit_by_residuals(responses_small.withColumn("wtp_aed_per_building", F.lit(7.0)), rounds=2)
    single = trees.of_trees(spark, flat.trees, flat.step, flat.start)
    assert single.depth == 0 and flat.losses == pytest.approx([0.0] * 3, abs=1e-12)
    assert trees.regression_sums(flat.matrix, single, "respondent_id").select(F.max("prediction")).first()[0] == pytest.approx(2.0794415416798357)
    assert {r["importance"] for r in trees.importances(single, REGRESSION_FEATURES, False).collect()} == {0.0}
    with pytest.raises(ValueError):
        price.fit_by_residuals(responses_small.withColumn("wtp_aed_per_building", F.lit(None).cast("double")), rounds=1)
