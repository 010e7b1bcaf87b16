"""Willingness-to-pay regression.

Gradient-boosted trees on ``log1p(wtp)``, trained on a hash-based 75/25 split of
the whole table. Metrics are DataFrame aggregates
(:mod:`canvass.operators.evaluate`). ``fit_boosting`` follows MLlib's boosting, which
weights the first tree by 1; ``fit_by_residuals`` starts at the targets' mean and
adds every tree with the same shrinkage, as the dashboard does. Both grow their trees
over packed bins (:mod:`canvass.operators.grow`), so scores are close to, not equal
to, scikit-learn's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators import grow
from canvass.operators.clean import feature_matrix
from canvass.operators.split import random_split
from canvass.plans.joins import stored
from canvass.sources.schema import REGRESSION_FEATURES


@dataclass
class BoostResult:
    model: grow.Boosted
    test_predictions: DataFrame
    importances: DataFrame
    matrix: DataFrame | None = None


@dataclass
class ResidualBoost:
    """Trees in the order of their rounds, the constant start, the shrinkage, the mean
    squared training error before the first and after each round, and the predictions of the test rows."""

    trees: list
    start: float
    step: float
    losses: list[float]
    matrix: DataFrame
    test_predictions: DataFrame


def _prepared(df: DataFrame, target: str, feats: list[str], id_col: str, test_fraction: float, seed: int) -> DataFrame:
    m = feature_matrix(df.where(F.col(target).isNotNull()), feats, keep=(id_col, target))
    m = m.withColumn("y", F.log1p(target))
    m = VectorAssembler(inputCols=feats, outputCol="features").transform(m)
    return stored(random_split(m, id_col, test_fraction, seed).select(id_col, "y", "features", "is_test"), "regression-matrix")


def _tested(m: DataFrame, model: grow.Boosted, id_col: str) -> DataFrame:
    return stored(model.transform(m.where(F.col("is_test"))).select(id_col, "y", "prediction"), "test-predictions")


def fit_boosting(df: DataFrame, target: str = "wtp_aed_per_building",
                 features: Sequence[str] = REGRESSION_FEATURES, id_col: str = "respondent_id",
                 rounds: int = 150, step: float = 0.05, depth: int = 4, seed: int = 42,
                 test_fraction: float = 0.25) -> BoostResult:
    feats = list(features)
    m = _prepared(df, target, feats, id_col, test_fraction, seed)
    model = grow.boost(m.where(~F.col("is_test")), len(feats), rounds, step, depth, id_col, from_mean=False)
    imp = df.sparkSession.createDataFrame(list(zip(feats, model.featureImportances)), "feature string, importance double")
    return BoostResult(model, _tested(m, model, id_col), imp, m)


def fit_by_residuals(df: DataFrame, target: str = "wtp_aed_per_building",
                     features: Sequence[str] = REGRESSION_FEATURES, id_col: str = "respondent_id",
                     rounds: int = 150, step: float = 0.05, depth: int = 4, seed: int = 42,
                     test_fraction: float = 0.25) -> ResidualBoost:
    """Least-squares boosting: the fit starts at the training targets' mean, each round
    fits a tree to the residuals and adds ``step`` times its leaf means.

    Raises ``ValueError`` without training rows."""
    feats = list(features)
    m = _prepared(df, target, feats, id_col, test_fraction, seed)
    model = grow.boost(m.where(~F.col("is_test")), len(feats), rounds, step, depth, id_col, from_mean=True)
    return ResidualBoost(model.trees, model.start, step, model.losses, m, _tested(m, model, id_col))
