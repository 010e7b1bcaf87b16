"""Distributions: equal-width histograms and box-plot statistics.

Histogram binning follows numpy's ``histogram`` exactly: edges
``lo + i * (hi - lo) / bins`` with the last edge ``hi``; a first guess
``floor((x - lo) / (hi - lo) * bins)`` corrected against the edges; the
maximum lands in the last bin; a constant range is widened by 0.5 each side.
Every bin appears, empty ones with 0 (bins come from ``sequence`` on the
per-group range table, left-joined to the counts).

Per-group statistics (range, quartiles) are one row per group and are joined
back to the rows on the group key after a size check (broadcast when small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.operators.profile import scoped
from canvass.operators.quantile import quantiles
from canvass.plans.joins import join_small


def _edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    step = (hi - lo) / F.lit(float(bins))
    return F.when(i >= bins, hi).otherwise(i.cast("double") * step + lo)


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """numpy's bin of ``x`` in ``[lo, hi]`` split into ``bins`` equal bins (0-based)."""
    guess = F.floor((x - lo) / (hi - lo) * F.lit(float(bins))).cast("long")
    guess = F.when(guess >= bins, F.lit(bins - 1).cast("long")).otherwise(guess)
    down = F.when(x < _edge(guess, lo, hi, bins), guess - 1).otherwise(guess)
    return F.when((x >= _edge(down + 1, lo, hi, bins)) & (down != bins - 1), down + 1).otherwise(down)


def histogram(df: DataFrame, col: str, bins: int, by=None, scale: float = 1.0) -> DataFrame:
    """``(by..., bin, lo_edge, hi_edge, count)`` over each group's own range.

    ``scale`` divides the values first (the bill chart is in thousands).
    Nulls are skipped.
    """
    data, keys = scoped(df, by)
    x = (F.col(col) / F.lit(scale)) if scale != 1.0 else F.col(col).cast("double")
    vals = data.select(*keys, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    rng = vals.groupBy(*keys).agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    rng = rng.select(*keys,
                     F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                     F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    counts = (join_small(vals, rng, keys)
              .select(*keys, bin_index(F.col("x"), lo, hi, bins).alias("bin"))
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")) \
        .withColumn("bin", F.col("bin").cast("long"))
    return (grid.join(counts, keys + ["bin"], "left")
            .select(*keys, "bin", _edge(F.col("bin"), lo, hi, bins).alias("lo_edge"),
                    _edge(F.col("bin") + 1, lo, hi, bins).alias("hi_edge"),
                    F.coalesce(F.col("count"), F.lit(0).cast("long")).alias("count")))


def box_stats(df: DataFrame, col: str, by=None, whis: float = 1.5, scale: float = 1.0) -> DataFrame:
    """Per group n, mean, q1, median, q3, iqr, whiskers, outlier counts.

    Quartiles are exact (linear interpolation, ``np.percentile``). Whiskers
    are the furthest values within ``whis * iqr`` of the box, clamped to the
    quartile when no value lies there (matplotlib's rule); outliers lie beyond
    the fences.
    """
    data, keys = scoped(df, by)
    x = (F.col(col) / F.lit(scale)) if scale != 1.0 else F.col(col).cast("double")
    vals = data.select(*keys, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    q = quantiles(vals, ["x"], [0.25, 0.5, 0.75], keys).groupBy(*keys).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lo_fence", F.col("q1") - F.lit(whis) * F.col("iqr")) \
        .withColumn("hi_fence", F.col("q3") + F.lit(whis) * F.col("iqr"))
    joined = join_small(vals, q, keys)
    agg = joined.groupBy(*keys, "q1", "median", "q3", "iqr", "lo_fence", "hi_fence").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"),
        F.min(F.when(F.col("x") >= F.col("lo_fence"), F.col("x"))).alias("w_lo"),
        F.max(F.when(F.col("x") <= F.col("hi_fence"), F.col("x"))).alias("w_hi"),
        F.count_if(F.col("x") < F.col("lo_fence")).alias("n_out_low"),
        F.count_if(F.col("x") > F.col("hi_fence")).alias("n_out_high"))
    whislo = F.when(F.col("w_lo").isNull() | (F.col("w_lo") > F.col("q1")), F.col("q1")).otherwise(F.col("w_lo"))
    whishi = F.when(F.col("w_hi").isNull() | (F.col("w_hi") < F.col("q3")), F.col("q3")).otherwise(F.col("w_hi"))
    return agg.select(*keys, "n", "mean", "q1", "median", "q3", "iqr", whislo.alias("whisker_low"),
                      whishi.alias("whisker_high"), "n_out_low", "n_out_high")


def box_outliers(df: DataFrame, col: str, by: str, id_col: str = "respondent_id",
                 whis: float = 1.5, scale: float = 1.0) -> DataFrame:
    """A19 outlier rows: ``(id, by, value, side)`` beyond each group's fences."""
    stats = box_stats(df, col, by, whis, scale).select(
        by, (F.col("q1") - F.lit(whis) * F.col("iqr")).alias("lo_fence"),
        (F.col("q3") + F.lit(whis) * F.col("iqr")).alias("hi_fence"))
    x = (F.col(col) / F.lit(scale)) if scale != 1.0 else F.col(col).cast("double")
    vals = df.where(F.col(by).isNotNull()).select(id_col, by, x.alias("value")).where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    j = join_small(vals, stats, [by])
    side = F.when(F.col("value") < F.col("lo_fence"), "low").when(F.col("value") > F.col("hi_fence"), "high")
    return j.select(id_col, by, "value", side.alias("side")).where(F.col("side").isNotNull())
