"""Deterministic train/test splits and fold ids (R1, L2, L4's folds).

Each row's side comes from an arithmetic hash of its id, so the split needs
no shuffle, does not depend on partitioning, survives recomputation after an
executor loss unchanged, and can be repeated in plain SQL.

``u(id) = int(first 12 hex digits of md5("<seed>:<id>")) / 2^48``: a uniform
value in [0, 1) that mixes neighbouring ids fully, with the same digits in any
engine that has ``md5``.
A stratified split cuts each class at its own quantile of the hash, so every
class keeps its share; neither split reproduces scikit-learn's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hex digits of the md5 digest used, and the matching scale.
HASH_HEX_DIGITS = 12
HASH_SCALE = float(16 ** HASH_HEX_DIGITS)


def unit_hash(id_col: str, seed: int = 42) -> Column:
    """A value in [0, 1) from the id and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    h = F.conv(F.substring(digest, 1, HASH_HEX_DIGITS), 16, 10).cast("long")
    return h.cast("double") / F.lit(HASH_SCALE)


def random_split(df: DataFrame, id_col: str = "respondent_id", test_fraction: float = 0.25,
                 seed: int = 42) -> DataFrame:
    """Adds ``is_test`` (true for about ``test_fraction`` of the rows)."""
    return df.withColumn("is_test", unit_hash(id_col, seed) < F.lit(test_fraction))


def stratified_split(df: DataFrame, label: str, id_col: str = "respondent_id",
                     test_fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """L2: adds ``is_test``: inside each class the rows whose hash is at or below
    the class's exact ``test_fraction`` quantile of the hash.

    The per-class thresholds come from the distributed quantile operator (no
    class is ever gathered into one task) and are joined back on the class.
    Rows without a class are never test rows.
    """
    from canvass.operators.quantile import quantiles
    from canvass.plans.joins import join_small
    d = df.withColumn("_u", unit_hash(id_col, seed))
    t = quantiles(d, ["_u"], [test_fraction], [label]).select(label, F.col("value").alias("_t"))
    out = join_small(d, t, [label], "left")
    return out.withColumn("is_test", F.coalesce(F.col("_u") <= F.col("_t"), F.lit(False))).drop("_u", "_t")


def stratified_folds(df: DataFrame, label: str, id_col: str = "respondent_id", folds: int = 5,
                     seed: int = 7) -> DataFrame:
    """L4's folds: adds an int ``fold`` in [0, folds) so that inside each class
    the folds are equal slices of the id hash (cut at the class's exact
    1/folds, 2/folds, ... quantiles), as stratified k-fold keeps class
    shares. Thresholds per class are folds - 1 numbers, joined on the class;
    rows without a class get fold 0."""
    from canvass.operators.quantile import quantiles
    from canvass.plans.joins import join_small
    d = df.withColumn("_u", unit_hash(id_col, seed))
    cuts = [i / folds for i in range(1, folds)]
    q = quantiles(d, ["_u"], cuts, [label])
    thr = q.groupBy(label).agg(F.array_sort(F.collect_list("value")).alias("_cuts"))
    out = join_small(d, thr, [label], "left")
    fold = F.size(F.filter(F.col("_cuts"), lambda t: t < F.col("_u")))
    return out.withColumn("fold", F.coalesce(F.when(F.col("_cuts").isNotNull(), fold), F.lit(0)).cast("int")) \
        .drop("_u", "_cuts")
