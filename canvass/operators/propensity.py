"""Adoption classification (L1-L5): label coding, balanced class weights,
random forest, cross-validated macro F1, importances, test-set report.

The forest follows MLlib's rules over packed bins (:mod:`canvass.operators.forest`);
cross-validation fits one forest per held-out fold;
class weights are the balanced rule ``n / (k * n_c)`` joined on the class.
The split and the cross-validation folds are stratified cuts of an id hash
(see :mod:`canvass.operators.split`).
The numbers will be close to, not equal to, scikit-learn's: different
splits, bootstrap draws and split finding.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.operators import evaluate, forest
from canvass.operators.clean import feature_matrix
from canvass.operators.split import stratified_folds, stratified_split
from canvass.plans.joins import join_small, stored
from canvass.sources.schema import CLASSIFIER_FEATURES


def label_encode(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """L1: alphabetical integer codes (as double, MLlib's label type)."""
    idx = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="skip")
    return idx.fit(df).transform(df)


def class_weights(df: DataFrame, col: str) -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` per class: ``(class, n_c, weight)``."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_c"))
    n = counts.select(F.sum("n_c")).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return counts.select(col, "n_c", (n.cast("double") / (k * F.col("n_c"))).alias("weight"))


@dataclass
class ForestResult:
    model: object
    labels: list
    test_predictions: DataFrame
    importances: DataFrame
    cv_metrics: DataFrame | None
    matrix: DataFrame | None = None


def fit_forest(df: DataFrame, label_col: str = "adoption_class",
               features: Sequence[str] = CLASSIFIER_FEATURES, id_col: str = "respondent_id",
               num_trees: int = 100, max_depth: int = 6, seed: int = 42, folds: int = 5,
               test_fraction: float = 0.25, cv_parallelism: int = 2, cross_validate: bool = True
               ) -> ForestResult:
    """Stratified split, balanced forest, test predictions, importances and k-fold macro F1."""
    feats = list(features)
    matrix = feature_matrix(df, feats, keep=(id_col, label_col)).where(F.col(label_col).isNotNull())
    matrix = label_encode(matrix, label_col, "label")
    weights = class_weights(matrix, label_col).select(label_col, "weight")
    data = join_small(matrix, weights, [label_col])
    data = VectorAssembler(inputCols=feats, outputCol="features").transform(data)
    data = stratified_folds(stratified_split(data, label_col, id_col, test_fraction, seed), label_col, id_col, folds)
    # every fit (final + one per fold) reads this matrix: write it once to the
    # shared checkpoint folder, which also cuts the long preparation lineage
    data = stored(data.select(id_col, label_col, "label", "weight", "features", "is_test", "fold"), "classification-matrix")
    classes = data.groupBy("label").agg(F.first(label_col).alias("name"), F.first("weight").alias("weight")).orderBy("label").collect()
    rf = forest.Estimator(len(feats), [r["weight"] for r in classes], num_trees, max_depth, seed, id_col)
    model = rf.fit(data.where(~F.col("is_test")))
    labels = [r["name"] for r in classes]
    names = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    # Test predictions feed several report tables: score the forest once.
    preds = stored(model.transform(data.where(F.col("is_test"))).select(
        id_col, F.col(label_col).alias("actual"), names.alias("predicted")), "test-predictions")
    spark: SparkSession = df.sparkSession
    imp = spark.createDataFrame([(f, float(v)) for f, v in zip(feats, model.featureImportances)],
                                "feature string, importance double")
    if not cross_validate:
        return ForestResult(model, labels, preds, imp, None, data)
    scores = cross_validated_macro_f1(rf, data, folds, cv_parallelism)
    mean = sum(scores) / len(scores)
    std = (sum((x - mean) ** 2 for x in scores) / (len(scores) - 1)) ** 0.5 if len(scores) > 1 else None
    cv_df = spark.createDataFrame([(float(mean), std, folds)],
                                  "cv_macro_f1 double, cv_macro_f1_std double, folds int")
    return ForestResult(model, labels, preds, imp, cv_df, data)


def cross_validated_macro_f1(estimator, data: DataFrame, folds: int, parallelism: int = 2) -> list[float]:
    """L4: fit on every fold but one, macro F1 on the held-out fold, per fold.

    Folds are the ``fold`` column (id hash), selected with plain filters;
    the fold fits run as concurrent Spark jobs.
    """
    from concurrent.futures import ThreadPoolExecutor

    def one(i: int) -> float:
        model = estimator.fit(data.where(F.col("fold") != i))
        scored = stored(model.transform(data.where(F.col("fold") == i)).select("label", "prediction"), "fold-predictions")
        return float(evaluate.macro_f1(scored, "label", "prediction").first()["macro_f1"])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(one, range(folds)))
