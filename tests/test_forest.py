"""The forest over packed bins: MLlib's trees, and nothing that grows with rows times trees."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from canvass.operators import evaluate, forest, grow

NAMES = ["a", "b", "c", "d", "e"]
WEIGHTS = [0.7, 1.9, 1.1]


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    df = spark.range(4000, numPartitions=3).select(
        k, (F.pmod(F.xxhash64(k), F.lit(9973)) / 7.0).alias("a"), (k % 3).cast("double").alias("b"),
        F.pmod(F.xxhash64(k + 1), F.lit(11)).cast("double").alias("c"), F.lit(4.0).alias("d"),
        F.pmod(F.xxhash64(k + 3), F.lit(7)).cast("double").alias("e"))
    score = F.sin(F.col("a") / 200) * 3 + F.col("b") * F.col("c") / 5 + F.pmod(F.xxhash64(k + 2), F.lit(100)) / 50
    df = df.withColumn("label", F.when(score > 3, 2.0).when(score > 1, 1.0).otherwise(0.0))
    df = df.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("label").cast("int") + 1))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).select("id", "label", "weight", "features").cache()


@pytest.mark.parametrize("depth", [0, 6])
def test_a_tree_equals_mllibs(spark, rows, depth):
    from pyspark.ml.classification import DecisionTreeClassifier
    theirs = DecisionTreeClassifier(weightCol="weight", maxDepth=depth, seed=1).fit(rows)
    ours = forest.fit(rows, 5, WEIGHTS, 1, depth, 1, "id", subset=5, bootstrap=False)
    assert len(ours.trees[0].left) == theirs.numNodes and ours.trees[0].depth == theirs.depth
    assert ours.featureImportances == pytest.approx(list(theirs.featureImportances.toArray()), abs=1e-9)
    both = ours.transform(rows).select("id", F.col("prediction").alias("ours"), vector_to_array("probability").alias("p")).join(
        theirs.transform(rows).select("id", "prediction", vector_to_array("probability").alias("q")), "id")
    off = F.exists(F.zip_with("p", "q", lambda a, b: F.abs(a - b)), lambda d: d > 1e-9)
    assert both.where(off | (F.col("ours") != F.col("prediction"))).count() == 0 and both.count() == 4000


def test_more_than_64_leaves(spark, rows):
    """Rows walk down such a tree; those that tables can hold end alike both ways."""
    from pyspark.ml.classification import DecisionTreeClassifier
    theirs = DecisionTreeClassifier(weightCol="weight", maxDepth=9, seed=1).fit(rows)
    ours = forest.fit(rows, 5, WEIGHTS, 1, 9, 1, "id", subset=5, bootstrap=False)
    tree = ours.trees[0]
    assert sum(left < 0 for left in tree.left) > 64 and len(tree.left) == pytest.approx(theirs.numNodes, rel=0.02)  # nodes of a few rows have equal gains
    f1 = [evaluate.macro_f1(m.transform(rows)).first()["macro_f1"] for m in (ours, theirs)]
    assert f1[0] == pytest.approx(f1[1], abs=0.005)
    small = forest.fit(rows, 5, WEIGHTS, 1, 5, 1, "id", subset=5, bootstrap=False)
    keys = grow.keys_of(small.lay, np.array([r[0] for r in rows.select(vector_to_array("features")).collect()])).astype(np.int64)
    walk = forest._Leaves(small.trees[0], small.lay)
    assert np.array_equal(np.array(walk.nodes)[walk.ends(keys)], grow._Way(small.trees[0], small.lay).ends(keys))


def test_a_forest_is_as_good_as_mllibs(spark, rows):
    from pyspark.ml.classification import RandomForestClassifier
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    theirs = RandomForestClassifier(weightCol="weight", numTrees=60, maxDepth=6, seed=3, featureSubsetStrategy="sqrt").fit(train)
    ours = forest.fit(train, 5, WEIGHTS, 60, 6, 3, "id")
    f1 = [evaluate.macro_f1(m.transform(test)).first()["macro_f1"] for m in (ours, theirs)]
    assert f1[0] == pytest.approx(f1[1], abs=0.03)
    assert ours.featureImportances == pytest.approx(list(theirs.featureImportances.toArray()), abs=0.05)


def test_a_level_is_one_scan_and_little_reaches_the_driver(spark, rows, monkeypatch):
    """Two jobs before and one a level however many trees there are, also where rows are in other partitions."""
    sc, jobs = spark.sparkContext, []
    for depth in (2, 5):
        sc.setJobGroup(f"depth-{depth}", "")
        forest.fit(rows, 5, WEIGHTS, 20, depth, 1, "id")
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"depth-{depth}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    first = forest.fit(rows, 5, WEIGHTS, 4, 5, 1, "id")
    again = forest.fit(rows.repartition(7), 5, WEIGHTS, 4, 5, 1, "id")
    assert jobs[1] - jobs[0] <= 3 + 1  # a level may take a job more where a checkpoint is written
    assert [t.threshold for t in first.trees] == [t.threshold for t in again.trees]
    # more scans a level, same trees
    monkeypatch.setattr(forest, "SCAN_BYTES", 1)
    split = forest.fit(rows, 5, WEIGHTS, 4, 5, 1, "id")
    assert [t.threshold for t in first.trees] == [t.threshold for t in split.trees]


def test_draws_are_poissons():
    draws = np.concatenate([forest._draws([1, t, 0, 0, 0], 100_000) for t in range(5)])
    assert draws.mean() == pytest.approx(1, abs=0.01) and draws.var() == pytest.approx(1, abs=0.02)
    assert (draws == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)


def test_odd_rows(spark, rows):
    with pytest.raises(ValueError):
        forest.fit(rows.limit(0), 5, WEIGHTS, 2, 3, 1, "id")
    with pytest.raises(ValueError):
        forest.fit(rows, 5, WEIGHTS[:2], 2, 3, 1, "id")
    nameless = forest.fit(rows.withColumn("id", F.lit(None).cast("long")), 5, WEIGHTS, 1, 4, 1, "id", subset=5, bootstrap=False)
    once = forest.fit(rows, 5, WEIGHTS, 1, 4, 1, "id", subset=5, bootstrap=False)
    twice = forest.fit(rows.unionByName(rows), 5, WEIGHTS, 1, 4, 1, "id", subset=5, bootstrap=False)
    assert once.trees[0].feature == nameless.trees[0].feature == twice.trees[0].feature
    assert twice.trees[0].reached[0] == pytest.approx(2 * once.trees[0].reached[0])
    # one row, and rows that are all alike
    for few in (rows.limit(1), rows.limit(1).crossJoin(spark.range(50).select(F.lit(1).alias("z")))):
        alone = forest.fit(few, 5, WEIGHTS, 3, 4, 1, "id")
        assert all(t.left == [-1] for t in alone.trees) and alone.featureImportances == [0.0] * 5
        assert alone.transform(few).count() == few.count()


def test_weighted_thresholds():
    values = np.arange(1000.0)
    assert grow.thresholds(values, weights=np.full(1000, 2.5)).tolist() == grow.thresholds(values).tolist()
    heavy = grow.thresholds(values, weights=np.where(values < 100, 100.0, 1.0))
    assert len(heavy) == grow.MAX_BINS - 1 and (heavy < 100).sum() > 25
