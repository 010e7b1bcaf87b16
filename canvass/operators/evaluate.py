"""Model evaluation as DataFrame aggregates.

All metrics are functions of ``(label, prediction)`` or ``(point, cluster)``
tables and run as partial/final aggregations; class grids and per-class
tables are at most (#classes)^2 rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.plans.joins import stored


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(actual, predicted, n)`` over the full class grid, 0-filled.

    Classes are the union of observed labels and predictions.
    """
    pairs = df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    classes = pairs.select(F.col("actual").alias("c")).union(pairs.select(F.col("predicted").alias("c"))) \
        .where(F.col("c").isNotNull()).agg(F.array_sort(F.collect_set("c")).alias("cs"))
    grid = classes.select(F.explode("cs").alias("actual"), "cs").select(
        "actual", F.explode("cs").alias("predicted"))
    return grid.join(pairs, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"))


def _safe_div(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(conf: DataFrame) -> DataFrame:
    """Per class tp, support, predicted count, precision, recall, F1 (0 when undefined)."""
    actual = conf.groupBy(F.col("actual").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                                           .otherwise(0)).alias("tp"))
    predicted = conf.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("n_pred"))
    t = actual.join(predicted, "cls", "full").na.fill(0, ["support", "tp", "n_pred"])
    p = _safe_div(F.col("tp").cast("double"), F.col("n_pred"))
    r = _safe_div(F.col("tp").cast("double"), F.col("support"))
    t = t.withColumn("precision", p).withColumn("recall", r)
    f1 = _safe_div(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return t.withColumn("f1_score", f1)


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per class plus 'accuracy', 'macro avg' and 'weighted avg'
    ``(label, precision, recall, f1_score, support)``, as sklearn's report dict."""
    # one row per class, read by all four parts of the report: compute once
    pc = stored(per_class(confusion(df, label, prediction)), "per-class")
    classes = pc.select(F.col("cls").alias("label"), "precision", "recall", "f1_score",
                        F.col("support").cast("long").alias("support"))
    tot = pc.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                 _safe_div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                 _safe_div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                 _safe_div(F.sum(F.col("f1_score") * F.col("support")), F.sum("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     _safe_div(F.col("tp").cast("double"), F.col("n")).alias("f1_score"),
                     F.col("n").cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1_score"),
                       F.col("n").cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1_score"),
                          F.col("n").cast("long").alias("support"))
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)


def macro_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """L4's metric: one row with macro F1, weighted F1 and accuracy."""
    pc = per_class(confusion(df, label, prediction))
    return pc.agg(F.avg("f1_score").alias("macro_f1"),
                  _safe_div(F.sum(F.col("f1_score") * F.col("support")), F.sum("support")).alias("weighted_f1"),
                  _safe_div(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"))


class MacroF1Evaluator(Evaluator):
    """Macro-averaged F1 as an MLlib ``Evaluator`` (MLlib's ``f1`` is
    support-weighted), for users of ``CrossValidator``/``TrainValidationSplit``."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol = labelCol
        self.predictionCol = predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(macro_f1(dataset, self.labelCol, self.predictionCol).first()["macro_f1"])

    def isLargerBetter(self) -> bool:
        return True


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "prediction", log_scale: bool = True
                       ) -> DataFrame:
    """R3 + R4: R^2 on the given scale; MAE back on the money scale when ``y``
    is ``log1p`` of money (``expm1`` of both sides)."""
    diff = F.col(y) - F.col(pred)
    err = (F.abs(F.expm1(y) - F.expm1(pred)) if log_scale else F.abs(diff))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(1.0) - F.try_divide(F.sum(diff * diff), F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(err).alias("mae"),
        F.avg(F.abs(diff)).alias("mae_model_scale"))


def actual_vs_predicted(df: DataFrame, id_col: str, y: str = "y", pred: str = "prediction") -> DataFrame:
    """``(id, actual, predicted)`` plus the common axis range of both."""
    rng = df.select(F.least(F.min(y), F.min(pred)).alias("lo"), F.greatest(F.max(y), F.max(pred)).alias("hi"))
    return df.select(id_col, F.col(y).alias("actual"), F.col(pred).alias("predicted"),
                     rng.select("lo").scalar().alias("axis_min"), rng.select("hi").scalar().alias("axis_max"))


# ---------------------------------------------------------------- clustering metrics
def inertia(points: DataFrame) -> DataFrame:
    """C6's metric per cluster: ``(cluster, inertia, size)``, the sum of squared
    distances to the cluster's mean.

    Input is long ``(point_id, cluster, dim, value)``, each point with every
    dimension. A dimension adds its count times its population variance, so one
    aggregation by (cluster, dim) does; its few rows are then summed.
    """
    per = points.groupBy("cluster", "dim").agg(F.count("value").alias("n"), F.var_pop("value").alias("v"))
    return per.groupBy("cluster").agg(F.sum(F.col("n") * F.col("v")).alias("inertia"), F.max("n").alias("size"))


def _summed_distances(clusters):
    """A batch of vectors to each one's summed squared distances to the points of every
    cluster: null for a vector (or cluster) with gaps or of another length."""
    width = max((len(k["s"] or ()) for k in clusters), default=0)
    whole = np.array([k["q"] is not None and len(k["s"] or ()) == width for k in clusters], bool)
    n, q = (np.array([k[c] or 0 for k in clusters], float) for c in ("n", "q"))
    s = np.array([k["s"] if w else [0.0] * width for k, w in zip(clusters, whole)], float).reshape(len(clusters), width)

    def away(x: pa.Array) -> pa.Array:
        flat = x.flatten()
        if flat.null_count or x.null_count or not pc.all(pc.equal(pc.list_value_length(x), width)).as_py():
            rows = [v if v is not None and len(v) == width and None not in v else None for v in x.to_pylist()]
            v = np.array([r or [0.0] * width for r in rows], float).reshape(len(rows), width)
            gaps = np.array([r is None for r in rows], bool)
        else:
            v, gaps = flat.to_numpy(zero_copy_only=False).reshape(len(x), width), np.zeros(len(x), bool)
        d = n * np.einsum("ij,ij->i", v, v)[:, None] - 2.0 * (v @ s.T) + q
        values = pa.array(d.ravel(), mask=(gaps[:, None] | ~whole).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(n), pa.int32()), values)
    return away


def silhouette_sq_euclidean(points: DataFrame, cluster: str = "cluster", vec: str = "vec") -> DataFrame:
    """C3 (scalable form): mean silhouette with squared Euclidean distance.

    For a point x and cluster C with n_C points, coordinate sums S_C and sum
    of squared norms Q_C, the summed squared distance from x to C is
    ``n_C*|x|^2 - 2 x.S_C + Q_C``, so per-cluster statistics replace all
    point pairs. a(x) averages over its own cluster without itself
    (n_A - 1), b(x) is the smallest average over the other clusters;
    s = (b - a) / max(a, b), and 0 for a point alone in its cluster or without
    another one (the definition MLlib's ``ClusteringEvaluator`` uses).

    Input: one row per point with an ``array<double>`` (or ML vector) column.
    Work: one aggregation for the k rows of statistics, which reach the points
    as one array (its size is the model's, k x d), then a map-only pass with one
    matrix product a batch and one global average. Returns ``(silhouette, n)``, no row
    for an empty table.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    x = vector_to_array(F.col(vec)) if dict(points.dtypes)[vec] == "vector" else F.col(vec).cast("array<double>")
    pts = points.select(F.col(cluster).alias("c"), x.alias("x")).where(F.col("c").isNotNull())
    sq = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)
    per = pts.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.sum(sq).alias("q"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col("x")))).alias("s"))
    # one row, written once: the distances and the clusters beside them stand in the same order
    every = stored(per.agg(F.array_sort(F.collect_list(F.struct("c", "n", "q", "s"))).alias("clusters")), "clusters")
    away = F.arrow_udf(_summed_distances(every.first()["clusters"]), "array<double>")
    sizes = every.select(F.transform("clusters", lambda k: F.struct(k.c.alias("c"), k.n.alias("n"))))
    far = pts.select("c", away("x").alias("away"), sizes.scalar().alias("clusters")).select("c", F.zip_with(
        "clusters", "away", lambda k, d: F.struct(k.c.alias("c"), k.n.alias("n"), d.alias("d"))).alias("far"))
    own = F.element_at(F.filter("far", lambda k: k.c == F.col("c")), 1)
    b = F.array_min(F.transform(F.filter("far", lambda k: k.c != F.col("c")), lambda k: k.d / k.n))
    near = far.select(own.alias("own"), b.alias("b")).withColumn("a", F.try_divide("own.d", F.col("own.n") - 1))
    sil = F.when((F.col("own.n") <= 1) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        _safe_div(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return near.agg(F.avg(sil).alias("silhouette"), F.count(F.lit(1)).alias("n")).where("n > 0")
