"""Boosting over packed bins: MLlib's trees, and one scan a level."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from canvass.operators import grow, price


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    df = spark.range(3000, numPartitions=3).select(
        k, (F.pmod(F.xxhash64(k), F.lit(9973)) / 7.0).alias("a"), (k % 3).cast("double").alias("b"),
        F.pmod(F.xxhash64(k + 1), F.lit(11)).cast("double").alias("c"), F.lit(4.0).alias("d"))
    df = df.withColumn("y", F.sin(F.col("a") / 200) + F.col("b") * F.col("c") / 5 + F.pmod(F.xxhash64(k + 2), F.lit(100)) / 90)
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).select("id", "y", "features").cache()


def test_boosting_equals_mllibs(spark, rows):
    from pyspark.ml.regression import GBTRegressor
    theirs = GBTRegressor(featuresCol="features", labelCol="y", maxIter=12, stepSize=0.1, maxDepth=3, seed=1).fit(rows)
    ours = grow.boost(rows, 4, 12, 0.1, 3, "id", from_mean=False)
    assert ours.treeWeights == pytest.approx(theirs.treeWeights)
    assert ours.featureImportances == pytest.approx(list(theirs.featureImportances.toArray()), abs=1e-9)
    both = ours.transform(theirs.transform(rows).withColumnRenamed("prediction", "theirs"))
    assert both.where(F.abs(F.col("prediction") - F.col("theirs")) > 1e-9).count() == 0
    assert ours.losses[0] > ours.losses[-1] == pytest.approx(both.agg(F.avg(F.pow(F.col("y") - F.col("theirs"), 2))).first()[0])


def test_a_round_is_one_scan_a_level(spark, rows, monkeypatch):
    """Rounds between two checkpoints: as many jobs as levels (MLlib's tree fits took several more)."""
    df = rows.select("id", F.expm1("y").alias("t"), F.pmod("id", F.lit(7)).alias("u"), (F.col("id") / 3).alias("v"))
    sc, jobs = spark.sparkContext, []
    for rounds in (2, 8):
        sc.setJobGroup(f"rounds-{rounds}", "")
        price.fit_by_residuals(df, "t", ["u", "v"], "id", rounds=rounds, depth=3)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] == 6 * 3


def test_odd_rows(spark, rows):
    with pytest.raises(ValueError):
        grow.boost(rows.limit(0), 4, 1, 0.1, 2, "id", from_mean=True)
    with pytest.raises(ValueError):
        grow.boost(rows.withColumn("y", F.when(F.col("id") > 5, F.col("y"))), 4, 1, 0.1, 2, "id", from_mean=True)
    twice = grow.boost(rows.unionByName(rows), 4, 3, 0.1, 2, "id", from_mean=True)
    once = grow.boost(rows, 4, 3, 0.1, 2, "id", from_mean=True)
    assert twice.losses == pytest.approx(once.losses, rel=1e-9)
    assert [t.feature for t in twice.trees] == [t.feature for t in once.trees]
    nameless = grow.boost(rows.withColumn("id", F.lit(None).cast("long")), 4, 3, 0.1, 2, "id", from_mean=True)
    assert nameless.losses == pytest.approx(once.losses, rel=1e-9)


def test_thresholds():
    assert grow.thresholds(np.array([1.0, 1, 2, 5])).tolist() == [1.5, 3.5]
    assert grow.thresholds(np.full(5, 3.0)).tolist() == []
    assert len(grow.thresholds(np.arange(1000.0))) == grow.MAX_BINS - 1
