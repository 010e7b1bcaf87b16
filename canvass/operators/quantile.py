"""Exact quantiles (linear interpolation) that never hold a large group in one task.

Semantics: for a group of ``n`` non-null values and probability ``p`` the
result interpolates between the order statistics at ranks ``floor(p*(n-1))``
and ``ceil(p*(n-1))`` (0-based), as pandas ``median``/``quantile``, numpy's
default ``percentile`` and DuckDB ``quantile_cont`` do.

Method (distributed selection):

1. One aggregation gives ``count/min/max`` per (group, metric). Each wanted
   rank starts with the bracket ``[min, max]`` and ``below = 0`` values under it.
2. While a bracket holds more than ``finish_limit`` values, one pass splits
   it into ``buckets`` equal-width buckets: a broadcast join of the (small)
   bracket table to the data, and a partial aggregation of
   ``count/min/max`` per bucket. A running sum over the at most ``buckets``
   rows of each bracket finds the bucket holding the rank; its exact
   ``[min, max]`` is the next bracket. The bracket's ends fall in different
   buckets, so every pass narrows it, and one whose min equals its max is
   solved; infinities are set apart in the first pass that meets them.
   The data (keys and values only) and each pass's brackets are written to the
   shared folder.
3. Brackets with at most ``finish_limit`` values are finished by a window
   ``row_number`` inside the bracket, so no task ever sorts more than
   ``finish_limit`` values, however large or skewed a group is.

When no group holds more than ``finish_limit`` distinct values (by an estimate, taken twice),
step 1 is followed by one count per distinct value and a running sum per group (bounded by the
same limit) instead of the selection passes. Both paths interpolate as ``lo + (hi - lo) * frac``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.plans.joins import join_small, stored

FINISH_LIMIT = 1_000_000
BUCKETS = 1024
# An estimated number of distinct values is taken this many times (its standard error is 5 %).
DISTINCT_MARGIN = 2
# Session settings that override the defaults above (per cluster sizing).
CONF_FINISH_LIMIT = "spark.canvass.quantile.finishLimit"
CONF_BUCKETS = "spark.canvass.quantile.buckets"


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``columns`` to ``(by..., metric, x double)`` without nulls or NaN."""
    keys = _as_list(by)
    cols = _as_list(columns)
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    long = wide.unpivot(keys, cols, "metric", "x")
    cond = F.col("x").isNotNull() & ~F.isnan("x")
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return long.where(cond)


def quantiles(df: DataFrame, columns, probs, by=(), *, finish_limit: int | None = None,
              buckets: int | None = None) -> DataFrame:
    """Exact interpolated quantiles of ``columns`` per ``by`` group.

    Returns ``(by..., metric, p, n, value)``; groups (or null keys) with no
    non-null value produce no row. ``finish_limit`` and ``buckets`` default
    to the session settings ``spark.canvass.quantile.finishLimit`` /
    ``.buckets`` when set, else 1,000,000 values and 1,024 buckets.
    """
    conf = df.sparkSession.conf
    if finish_limit is None:
        finish_limit = int(conf.get(CONF_FINISH_LIMIT, None) or FINISH_LIMIT)
    if buckets is None:
        buckets = int(conf.get(CONF_BUCKETS, None) or BUCKETS)
    keys = _as_list(by)
    probs = [float(p) for p in _as_list(probs)]
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability {p} outside [0, 1]")
    if buckets < 3:
        raise ValueError("a pass needs at least 3 buckets")
    gk = keys + ["metric"]
    data = long_values(df, columns, keys)

    stats = data.groupBy(*gk).agg(F.count("x").alias("n"), F.approx_count_distinct("x").alias("distinct"))
    largest = stats.agg(F.max(F.least("n", F.col("distinct") * DISTINCT_MARGIN))).first()[0]
    if largest is None or largest <= finish_limit:
        return _direct(data, keys, gk, probs)
    data = stored(data, "quantile-values")
    stats = stored(data.groupBy(*gk).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "quantile-stats")
    targets = (
        stats.select(*gk, "n", F.explode(F.array(*[F.lit(p) for p in probs])).alias("p"))
        .withColumn("pos", F.col("p") * (F.col("n") - 1))
        .withColumn("k0", F.floor("pos").cast("long"))
        .withColumn("k1", F.ceil("pos").cast("long"))
        .withColumn("frac", F.col("pos") - F.col("k0"))
    )
    ranks = (
        targets.select(*gk, F.explode(F.array_distinct(F.array("k0", "k1"))).alias("k"))
        .distinct()
        .join(stats, gk)
        .select(*gk, "k", F.col("lo"), F.col("hi"), F.lit(0).cast("long").alias("below"),
                F.col("n").alias("cnt"))
    )
    state = stored(ranks, "quantile-state")
    active = (F.col("lo") < F.col("hi")) & (F.col("cnt") > finish_limit)
    while not state.where(active).isEmpty():
        state = _refine(data, state, active, gk, buckets)

    values = _finish(data, state, gk)
    t0 = values.select(*gk, F.col("k").alias("k0"), F.col("v").alias("v0"))
    t1 = values.select(*gk, F.col("k").alias("k1"), F.col("v").alias("v1"))
    out = (
        targets.join(t0, gk + ["k0"]).join(t1, gk + ["k1"])
        .select(*keys, "metric", "p", "n",
                _between(F.col("v0"), F.col("v1"), F.col("frac")).alias("value"))
    )
    return out


def _between(v0, v1, frac):
    """Linear interpolation; equal ends (infinite ones too) are the value itself."""
    return F.when((v0 == v1) | (frac == 0), v0).otherwise(v0 + (v1 - v0) * frac)


def _direct(data: DataFrame, keys: list[str], gk: list[str], probs: list[float]) -> DataFrame:
    """Every group holds at most ``finish_limit`` distinct values.

    Values are first counted per (group, value) with map-side partial
    aggregation, so repeated values (integer scores, flags) collapse before
    the shuffle. A running sum over each group's distinct values (at most
    ``finish_limit`` rows) gives the rank range each value covers, and the
    values covering the two ranks of each probability are kept.
    """
    counted = data.groupBy(*gk, "x").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*gk).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*gk)
    ranked = counted.select(*gk, "x", "c", F.sum("c").over(upto).alias("end"),
                            F.sum("c").over(whole).alias("n"))
    last = F.col("n") - 1
    start = F.col("end") - F.col("c")

    def covers(k):
        return (k >= start) & (k < F.col("end"))

    wanted = F.filter(F.array(*[F.lit(p) for p in probs]),
                      lambda p: covers(F.floor(p * last)) | covers(F.ceil(p * last)))
    hits = ranked.select(*gk, "x", "c", "end", "n", F.explode(wanted).alias("p"))
    pos = F.col("p") * (F.col("n") - 1)
    ends = hits.groupBy(*gk, "p", "n").agg(
        F.max(F.when(covers(F.floor(pos)), F.col("x"))).alias("v0"),
        F.max(F.when(covers(F.ceil(pos)), F.col("x"))).alias("v1"))
    frac = pos - F.floor(pos)
    return ends.select(*keys, "metric", "p", "n",
                       _between(F.col("v0"), F.col("v1"), frac).alias("value"))


def _refine(data: DataFrame, state: DataFrame, active, gk: list[str], buckets: int) -> DataFrame:
    """One bucketing pass over the data for every unsolved bracket."""
    bkey = gk + ["lo", "hi", "below"]
    open_ = state.where(active)
    brackets = open_.select(*bkey).distinct()
    inside = join_small(data, brackets, gk).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    inf = float("inf")
    # halves, so that the width of a bracket can't overflow
    share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    linear = F.when(F.col("x") >= F.col("hi"), F.lit(buckets - 1)).otherwise(
        F.least(F.floor(share * (buckets - 1)), F.lit(buckets - 2)))
    ends = F.when(F.col("x") == -inf, F.lit(0)).when(F.col("x") == inf, F.lit(2)).otherwise(F.lit(1))
    bucket = F.when((F.col("lo") == -inf) | (F.col("hi") == inf), ends).otherwise(linear).cast("long")
    hist = inside.groupBy(*bkey, bucket.alias("b")).agg(
        F.count("x").alias("c"), F.min("x").alias("bmin"), F.max("x").alias("bmax"))
    run = Window.partitionBy(*gk, "lo", "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("start", F.col("below") + F.sum("c").over(run) - F.col("c"))
    moved = (
        open_.join(hist, bkey)
        .where((F.col("k") >= F.col("start")) & (F.col("k") < F.col("start") + F.col("c")))
        .select(*gk, "k", F.col("bmin").alias("lo"), F.col("bmax").alias("hi"),
                F.col("start").alias("below"), F.col("c").alias("cnt"))
    )
    return stored(state.where(~active).unionByName(moved), "quantile-state")


def _finish(data: DataFrame, state: DataFrame, gk: list[str]) -> DataFrame:
    """Pick the value at rank ``k`` of every bracket -> ``(gk..., k, v)``."""
    solved = state.where(F.col("lo") == F.col("hi")).select(*gk, "k", F.col("lo").alias("v"))
    rest = state.where(F.col("lo") < F.col("hi"))
    bkey = gk + ["lo", "hi", "below"]
    brackets = rest.select(*bkey).distinct()
    inside = join_small(data, brackets, gk).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    order = Window.partitionBy(*gk, "lo", "hi").orderBy("x")
    ranked = inside.withColumn("r", F.col("below") + F.row_number().over(order) - 1)
    picked = (
        ranked.join(rest.select(*gk, "lo", "hi", F.col("k").alias("r")), gk + ["lo", "hi", "r"])
        .select(*gk, F.col("r").alias("k"), F.col("x").alias("v"))
    )
    return solved.unionByName(picked)


def medians(df: DataFrame, columns, by=(), **kw) -> DataFrame:
    """Exact median of each column per group, wide: ``(by..., <column>...)``."""
    return quantiles_wide(df, columns, 0.5, by, **kw)


def quantiles_wide(df: DataFrame, columns, p: float, by=(), **kw) -> DataFrame:
    keys = _as_list(by)
    cols = _as_list(columns)
    q = quantiles(df, cols, [p], keys, **kw)
    aggs = [F.max(F.when(F.col("metric") == c, F.col("value"))).alias(c) for c in cols]
    if keys:
        return q.groupBy(*keys).agg(*aggs)
    return q.agg(*aggs)


def median_values(df: DataFrame, columns, **kw) -> dict[str, float | None]:
    """Global exact medians as Python floats (one number per column)."""
    cols = _as_list(columns)
    row = medians(df, cols, **kw).first()
    return {c: (None if row is None else row[c]) for c in cols}
