"""Fitted trees as a table of nodes.

A fitted ensemble becomes a table with one row per node: tree, its weight, node,
children, feature, threshold, gain, the training weight that reached the node, its
value and its class shares. Rows are scored against the table level by level: each
(row, tree) stands at a node, and one equality join on (tree, node) a level moves it to a
child. The model's own scoring has no part in it, so the table is an account of the
fit that any SQL engine can read, and importances follow from its gains.

A level's work is rows x trees and needs no shuffle while the node table (at most
2^(depth + 1) rows a tree, whatever the input) is below Spark's broadcast bound;
the sums over a row's trees are combined before their one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.operators.forest import ClassTree, Forest
from canvass.operators.grow import Boosted, Tree
from canvass.plans.joins import stored
from canvass.session import scratch_path

@dataclass
class TreeTable:
    """``nodes`` of ``trees`` trees, none deeper than ``depth``; ``start`` is added to a regression's sum."""

    nodes: DataFrame
    trees: int
    depth: int
    start: float = 0.0


def of_ensemble(spark: SparkSession, model) -> TreeTable:
    """The table of a fitted forest or boosting model: one of MLlib's is read from its written form."""
    if isinstance(model, (Boosted, Forest)):
        return _of_lists(spark, model.trees, model.treeWeights, getattr(model, "start", 0.0))
    path = scratch_path(spark, "ensemble")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    weights = [float(w) for w in model.treeWeights]
    return _table(rows, weights, hasattr(model, "numClasses"), max(t.depth for t in model.trees))


def of_trees(spark: SparkSession, trees: Sequence[Tree], weight: float, start: float) -> TreeTable:
    """The table of regression trees that were fitted one by one, all with one weight."""
    return _of_lists(spark, trees, [weight] * len(trees), start)


def _of_lists(spark: SparkSession, trees: Sequence[Tree], weights: Sequence[float], start: float) -> TreeTable:
    rows = []
    for number, (t, weight) in enumerate(zip(trees, weights)):
        for i, (left, right) in enumerate(zip(t.left, t.right)):
            split = (left, right, t.feature[i], t.threshold[i], t.gain[i]) if left >= 0 else (None,) * 5
            rows.append((number, float(weight), i, *split, t.reached[i], t.value[i], t.shares(i) if isinstance(t, ClassTree) else []))
    nodes = spark.createDataFrame(rows, "tree int, tree_weight double, node int, left int, right int, feature int, threshold double, "
                                        "gain double, reached double, value double, votes array<double>")
    return TreeTable(stored(nodes.coalesce(1), "tree-nodes"), len(trees), max(t.depth for t in trees), start)


def _table(rows: DataFrame, weights: list[float], classes: bool, depth: int) -> TreeTable:
    inner = F.col("leftChild") >= 0
    if rows.where(inner & (F.col("split.numCategories") >= 0)).limit(1).count():
        raise ValueError("a tree splits a categorical feature: the table holds thresholds only")
    stats = F.col("impurityStats")
    # classes: a weight for each; regression: weight, sum and sum of squares
    reached = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x) if classes else F.get(stats, F.lit(0))
    nodes = rows.select(
        "tree", F.element_at(F.array(*map(F.lit, weights)), F.col("tree") + 1).alias("tree_weight"), F.col("id").alias("node"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("gain")).alias("gain"), reached.alias("reached"), F.col("prediction").alias("value"),
        (F.transform(stats, lambda x: x / reached) if classes else F.array().cast("array<double>")).alias("votes"))
    return TreeTable(stored(nodes, "tree-nodes"), len(weights), depth)


def leaves(df: DataFrame, table: TreeTable, id_col: str, features: str = "features") -> DataFrame:
    """(id, tree, tree_weight, value, votes): the leaf that each row reaches in each tree.

    ``features`` is a vector column without gaps; a value equal to a threshold goes left. An empty input gives no rows."""
    moves = table.nodes.select("tree", F.col("node").alias("at"), "left", "right", "feature", "threshold")
    here = df.select(id_col, vector_to_array(F.col(features)).alias("x"),
                     F.explode(F.sequence(F.lit(0), F.lit(table.trees - 1))).alias("tree"), F.lit(0).alias("at"))
    for _ in range(table.depth):
        child = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        here = here.join(moves, ["tree", "at"]).select(
            id_col, "x", "tree", F.when(F.col("left").isNull(), F.col("at")).otherwise(child).alias("at"))
    ends = table.nodes.select("tree", F.col("node").alias("at"), "tree_weight", "value", "votes")
    return here.join(ends, ["tree", "at"]).select(id_col, "tree", "tree_weight", "value", "votes")


def class_shares(df: DataFrame, table: TreeTable, n_classes: int, id_col: str, features: str = "features") -> DataFrame:
    """(id, shares, prediction): the mean of the leaves' class shares, and the place of the largest (the first of equal ones)."""
    sums = [F.sum(F.get("votes", F.lit(k)) * F.col("tree_weight")) for k in range(n_classes)]
    whole = leaves(df, table, id_col, features).groupBy(id_col).agg(F.array(*sums).alias("sums"), F.sum("tree_weight").alias("weight"))
    shares = whole.select(id_col, F.transform("sums", lambda s: s / F.col("weight")).alias("shares"))
    return shares.withColumn("prediction", (F.array_position("shares", F.array_max("shares")) - 1).cast("double"))


def regression_sums(df: DataFrame, table: TreeTable, id_col: str, features: str = "features") -> DataFrame:
    """(id, prediction): the start and the weighted sum of the leaves' values."""
    total: Column = F.lit(table.start) + F.sum(F.col("tree_weight") * F.col("value"))
    return leaves(df, table, id_col, features).groupBy(id_col).agg(total.alias("prediction"))


def importances(table: TreeTable, features: Sequence[str], per_tree: bool) -> DataFrame:
    """(feature, importance): each feature's gains times the weight that reached their
    nodes, as shares of all; ``per_tree`` first makes each tree's sum to 1 (as forests
    do). Features without a split have 0, and so have all if no tree splits."""
    gained = table.nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("reached")).alias("g"))
    if per_tree:
        whole = gained.groupBy("tree").agg(F.sum("g").alias("all"))
        gained = gained.join(whole, "tree").where(F.col("all") > 0).select("feature", (F.col("g") / F.col("all")).alias("g"))
    names = table.nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    each = names.join(gained.groupBy("feature").agg(F.sum("g").alias("g")), "feature", "left").select(
        "name", F.coalesce("g", F.lit(0.0)).alias("g"))
    total = each.select(F.sum("g")).scalar()
    return each.select(F.col("name").alias("feature"), F.when(total > 0, F.col("g") / total).otherwise(F.lit(0.0)).alias("importance"))
