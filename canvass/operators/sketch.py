"""Approximate quantiles by mergeable sketches: the opt-in for A3, A6 and A14.

A sketch takes one pass with partial aggregation, is a few kilobytes whatever
the group's size, and sketches of parts merge to that of the whole. Its quantile is
a value of the group whose rank is near the wanted one, not an interpolation;
:data:`RANK_ERROR` bounds how far off the rank is, as a share of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators.quantile import _as_list, long_values
from canvass.plans.joins import join_small

#: Size parameter of a sketch, and the rank error (share of a group) that it keeps:
#: about 0.1 % with 99 % confidence, five times that practically always.
SKETCH_K = 4096
RANK_ERROR = 0.005


def sketches(df: DataFrame, columns: Sequence[str], by=(), k: int = SKETCH_K) -> DataFrame:
    """(by..., metric, n, sketch) of the values that are neither null nor NaN; rows with a null key are left out."""
    keys = _as_list(by)
    return long_values(df, columns, keys).groupBy(*keys, "metric").agg(
        F.count("x").alias("n"), F.kll_sketch_agg_double("x", k).alias("sketch"))


def merged(parts: DataFrame, by=()) -> DataFrame:
    """(by..., metric, n, sketch): sketches of parts rolled up to fewer keys."""
    return parts.groupBy(*_as_list(by), "metric").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles_of(parts: DataFrame, probs) -> DataFrame:
    """(by..., metric, p, n, value) of each sketch."""
    keys = [c for c in parts.columns if c not in ("metric", "n", "sketch")]
    ranks = F.array(*[F.lit(float(p)) for p in _as_list(probs)])
    found = F.arrays_zip(ranks.alias("p"), F.kll_sketch_get_quantile_double("sketch", ranks).alias("value"))
    return parts.where("n > 0").select(*keys, "metric", "n", F.explode(found).alias("q")).select(
        *keys, "metric", F.col("q.p").alias("p"), "n", F.col("q.value").alias("value"))


def approx_quantiles(df: DataFrame, columns, probs, by=(), k: int = SKETCH_K) -> DataFrame:
    """The same columns as :func:`canvass.operators.quantile.quantiles`, approximate, in one pass."""
    return quantiles_of(sketches(df, _as_list(columns), by, k), probs)


def rank_errors(df: DataFrame, found: DataFrame, columns, by=()) -> DataFrame:
    """(by..., metric, p, n, error): how far the wanted rank p is from the ranks
    that each found value (by..., metric, p, value) has among the values, as a share of the group; exact."""
    keys = [*_as_list(by), "metric"]
    wanted = found.groupBy(*keys).agg(F.collect_list(F.struct("p", "value")).alias("wanted"))
    each = join_small(long_values(df, _as_list(columns), by), wanted, keys).select(*keys, "x", F.explode("wanted").alias("w"))
    ranks = each.groupBy(*keys, F.col("w.p").alias("p")).agg(
        F.count("x").alias("n"), F.count_if(F.col("x") < F.col("w.value")).alias("below"), F.count_if(F.col("x") <= F.col("w.value")).alias("upto"))
    error = F.greatest(F.col("below") / F.col("n") - F.col("p"), F.col("p") - F.col("upto") / F.col("n"), F.lit(0.0))
    return ranks.select(*keys, "p", "n", error.alias("error"))
