"""Customer clustering.

* C1: features are median-imputed and standardised with the population
  standard deviation (a constant column is divided by 1). The 2 x d means and
  deviations are one aggregation; the scaled matrix is plain column
  arithmetic inside whole-stage codegen.
* C2: MLlib k-means (k-means|| init) fitted once per seed; the fit with the
  lowest training cost wins (the "best of n starts" rule). Seed fits run as
  concurrent Spark jobs from a small thread pool on one persisted matrix.
  Cluster numbers are arbitrary, so they are renumbered by size (largest
  first), ties by centroid.
* C4/C5: MLlib PCA (covariance from a distributed aggregation). Each
  component's sign is fixed so its largest-magnitude loading is positive;
  points and centroids are projected with the same loadings.
* C2 for several k, and C6: :func:`kmeans_shared` advances all models in shared
  scans; the elbow curve is the best-of-seeds cost for each k.
* C3: :func:`canvass.operators.evaluate.silhouette_sq_euclidean` (closed form) and
  :func:`canvass.operators.silhouette.silhouette_euclidean` (blocked distances).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.labels import lookup
from canvass.operators.clean import feature_matrix
from canvass.operators.lloyd import SharedFit, best_by_k, fit_models, nearest
from canvass.session import checkpoint_dir
from canvass.sources.schema import CLUSTER_FEATURES


def _named(cluster):
    return F.concat(F.lit("Cluster "), cluster.cast("string"))


def scaled_matrix(df: DataFrame, features: Sequence[str] = CLUSTER_FEATURES,
                  id_col: str = "respondent_id", keep: dict[str, str] | None = None) -> DataFrame:
    """Imputed features standardised to mean 0 and population std 1.

    ``keep`` carries raw columns along under other names (name -> column)."""
    feats, keep = list(features), keep or {}
    m = feature_matrix(df.withColumns({name: F.col(c) for name, c in keep.items()}), feats, keep=(id_col, *keep))
    stats = m.agg(*[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(feats)],
                  *[F.stddev_pop(c).alias(f"std_{i}") for i, c in enumerate(feats)]).first()
    cols = []
    for i, c in enumerate(feats):
        mu, sd = stats[f"mean_{i}"], stats[f"std_{i}"]
        sd = sd if sd not in (None, 0.0) else 1.0
        cols.append(((F.col(c) - F.lit(mu)) / F.lit(sd)).alias(c))
    return m.select(id_col, *keep, *cols)


def with_vector(matrix: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(matrix)


@dataclass
class KMeansFit:
    model: object
    cost: float
    seed: int
    k: int
    order: dict  # original cluster number -> renumbered


def sklearn_tol(vectors: DataFrame, k: int, rel_tol: float = 1e-4) -> float:
    """Spark tolerance that implies scikit-learn's stopping rule.

    scikit-learn stops when the summed squared centre shift is below
    ``rel_tol * mean feature variance``; MLlib stops when every centre moved
    less than ``tol``. With ``tol = sqrt(rel_tol * mean_var / k)`` the MLlib
    rule implies the scikit-learn one. The variances come from one
    distributed ``Summarizer`` aggregation.
    """
    from pyspark.ml.stat import Summarizer
    var = vectors.select(Summarizer.metrics("variance").summary(F.col("features")).alias("s")) \
        .first()["s"]["variance"].toArray()
    mean_var = float(sum(var) / len(var)) if len(var) else 0.0
    return max((rel_tol * mean_var / k) ** 0.5, 1e-12)


def _fit(data: DataFrame, k: int, seed: int, max_iter: int, tol: float):
    km = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="features",
                predictionCol="cluster_raw")
    model = km.fit(data)
    return model, float(model.summary.trainingCost), seed


# Rows per partition of a k-means input, and its least number of partitions.
FIT_PARTITION_ROWS = 250_000
FIT_PARTITIONS = 8


def _fit_input(vectors: DataFrame, id_col: str = "respondent_id", rows: int = FIT_PARTITION_ROWS) -> DataFrame:
    """The vector column, written to the shared folder's checkpoint, in a layout
    that follows from the data alone.

    MLlib's starting centres depend on the partitions and their order, so rows go
    to a partition by a hash of their id and are sorted by it; the number of
    partitions depends on the number of rows, not on the cluster. The same table
    gives the same clusters wherever it runs.
    """
    n = vectors.count()
    parts = max(FIT_PARTITIONS, -(-n // rows))
    checkpoint_dir(vectors.sparkSession)
    return (vectors.select(id_col, "features").repartition(parts, id_col).sortWithinPartitions(id_col)
            .select("features").checkpoint(eager=True))


def kmeans_best(vectors: DataFrame, k: int = 5, seeds: Sequence[int] = range(42, 52),
                max_iter: int = 300, tol: float | None = None, parallelism: int = 10) -> KMeansFit:
    """Best (lowest cost) of one k-means fit per seed (all seeds run concurrently).

    ``tol`` defaults to :func:`sklearn_tol` (scikit-learn's relative 1e-4).
    """
    data = _fit_input(vectors).persist(StorageLevel.MEMORY_AND_DISK)
    tol = sklearn_tol(data, k) if tol is None else tol
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(list(seeds))))) as pool:
        fits = list(pool.map(lambda s: _fit(data, k, s, max_iter, tol), list(seeds)))
    data.unpersist()
    model, cost, seed = min(fits, key=lambda t: (t[1], t[2]))
    sizes = list(model.summary.clusterSizes)
    centers = [tuple(float(v) for v in c) for c in model.clusterCenters()]
    ranked = sorted(range(len(sizes)), key=lambda j: (-sizes[j], centers[j]))
    return KMeansFit(model, cost, seed, k, {old: new for new, old in enumerate(ranked)})


def assign(fit: KMeansFit | SharedFit, vectors: DataFrame, names: dict | None = None) -> DataFrame:
    """Every row with its (renumbered) cluster and the cluster's name:
    ``names`` by number, else ``Cluster n``."""
    if isinstance(fit, SharedFit):
        out = vectors.withColumn("cluster", nearest(fit))
    else:
        out = fit.model.transform(vectors)
        out = out.withColumn("cluster", lookup(F.col("cluster_raw"), fit.order).cast("int")).drop("cluster_raw")
    own = _named(F.col("cluster"))
    return out.withColumn("cluster_name", F.coalesce(lookup(F.col("cluster"), names), own) if names else own)


def kmeans_shared(vectors: DataFrame, ks: Sequence[int] = range(2, 10), seeds: Sequence[int] = range(42, 52),
                  features: Sequence[str] = CLUSTER_FEATURES, id_col: str = "respondent_id", max_iter: int = 300) -> dict[int, SharedFit]:
    """The best of all seeds' models for each k, all of them fitted in
    shared scans (:mod:`canvass.operators.lloyd`)."""
    return best_by_k(fit_models(vectors, features, ks, seeds, id_col, max_iter))


def elbow_of(vectors: DataFrame, fits: dict[int, SharedFit]) -> DataFrame:
    """``(k, inertia)`` of fitted models."""
    return vectors.sparkSession.createDataFrame([(k, fits[k].cost) for k in sorted(fits)], "k int, inertia double")


def elbow(vectors: DataFrame, ks: Sequence[int] = range(2, 10), seeds: Sequence[int] = range(42, 52),
          max_iter: int = 300, features: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    """``(k, inertia)``, inertia being the best-of-seeds sum of squared distances."""
    return elbow_of(vectors, kmeans_shared(vectors, ks, seeds, features, max_iter=max_iter))


@dataclass
class PCAFit:
    loadings: list  # per component, list of d weights (sign fixed)
    explained: list  # variance ratio per component
    features: list


def fit_pca(vectors: DataFrame, features: Sequence[str], k: int = 2) -> PCAFit:
    """C4: principal axes and explained-variance ratios, signs fixed."""
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(vectors)
    pc = model.pc.toArray()  # d x k
    loadings = []
    for j in range(k):
        col = [float(v) for v in pc[:, j]]
        top = max(range(len(col)), key=lambda i: abs(col[i]))
        sign = -1.0 if col[top] < 0 else 1.0
        loadings.append([sign * v for v in col])
    return PCAFit(loadings, [float(v) for v in model.explainedVariance.toArray()], list(features))


def project(df: DataFrame, pca: PCAFit, keep: Sequence[str]) -> DataFrame:
    """Coordinates ``pc1, pc2, ...`` of the wide feature columns (column arithmetic)."""
    comps = []
    for j, w in enumerate(pca.loadings):
        expr = None
        for c, wi in zip(pca.features, w):
            term = F.col(c) * F.lit(wi)
            expr = term if expr is None else expr + term
        comps.append(expr.alias(f"pc{j + 1}"))
    return df.select(*keep, *comps)


def centroids(fit: KMeansFit | SharedFit, features: Sequence[str], names: dict | None = None) -> DataFrame:
    """C5 input: the k centroids (renumbered) as a k-row wide DataFrame."""
    from canvass.session import get_session
    spark = get_session()
    rows = []
    numbered = enumerate(fit.centers) if isinstance(fit, SharedFit) else ((fit.order[j], c) for j, c in enumerate(fit.model.clusterCenters()))
    for new, center in numbered:
        rows.append((new, (names or {}).get(new, f"Cluster {new}"), *[float(v) for v in center]))
    schema = "cluster int, cluster_name string, " + ", ".join(f"`{c}` double" for c in features)
    return spark.createDataFrame(rows, schema)


def variance_table(pca: PCAFit) -> DataFrame:
    from canvass.session import get_session
    return get_session().createDataFrame(
        [(f"PC{j + 1}", v * 100.0) for j, v in enumerate(pca.explained)], "component string, variance_pct double")


def cluster_profile(assigned: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Members per cluster and the mean of the (unscaled) columns that ride
    along with the assigned rows: name of the mean -> column."""
    return assigned.groupBy("cluster", "cluster_name").agg(
        F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(name) for name, c in cols.items()])
