"""Crosstabs and group profiles.

Canonical results are long ``(group, category, value)`` tables. Windows here
run over already-aggregated rows, partitioned by a category, so a partition
holds at most one row per other category, never raw data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions.labels import title_label
from canvass.operators.clean import number


def crosstab(df: DataFrame, row: str, col: str, percent: bool = True) -> DataFrame:
    """Row-normalised crosstab, long form ``(row, col, n, pct)``.

    Pairs with a null on either side are left out of counts and denominators.
    Every pair of an observed row and an observed column value appears, with
    n = 0 and pct = 0 if no respondent has it.
    """
    pairs = (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
             .groupBy(row, col).agg(F.count(F.lit(1)).alias("n")))
    return cells(pairs, row, col, percent)


def cells(pairs: DataFrame, row: str, col: str, percent: bool = True) -> DataFrame:
    """The crosstab of counted pairs (row, col, n)."""
    columns = pairs.agg(F.collect_set(col))  # as many as the category has values
    grid = pairs.select(row).distinct().select(row, F.explode(columns.scalar()).alias(col))
    counted = grid.join(pairs, [row, col], "left").select(row, col, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = F.sum("n").over(Window.partitionBy(row))
    scale = F.lit(100.0) if percent else F.lit(1.0)
    return counted.select(row, col, "n", F.try_divide(F.col("n") * scale, total).alias("pct"))


def crosstab_wide(df: DataFrame, row: str, col: str, values: Sequence[str],
                  percent: bool = True) -> DataFrame:
    """A11+A12: wide crosstab with a fixed column order; missing cells are 0.

    The shares are computed over every category (listed or not), then the
    listed ones become columns, as ``crosstab(...).reindex(columns, fill_value=0)``.
    The explicit value list avoids the extra job ``pivot`` would spend finding it.
    """
    long = crosstab(df, row, col, percent)
    return (long.groupBy(row).pivot(col, list(values)).agg(F.first("pct"))
            .fillna(0.0, subset=list(values)))


def group_means(df: DataFrame, by: str, cols: Sequence[str], prefix: str = "",
                metric_name: str = "item", value_name: str = "rate") -> DataFrame:
    """A13 + P2: mean of each column per group, long with a title-case label.

    One aggregation, then ``unpivot``; nulls and NaN are skipped.
    """
    wide = df.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.avg(number(c)).alias(c) for c in cols])
    long = wide.unpivot([by], list(cols), metric_name, value_name)
    return long.withColumn("label", title_label(metric_name, prefix))


def minmax_across_groups(long: DataFrame, group: str, metric: str = "metric",
                         value: str = "mean") -> DataFrame:
    """Per metric, ``(v - min) / (max - min)`` across the groups.

    With one group (or equal values) the ratio is 0/0: null here, NaN in pandas.
    """
    w = Window.partitionBy(metric)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return long.withColumn("scaled", F.try_divide(F.col(value) - lo, hi - lo))


def score_profile(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """A13 + A15 on the score columns: ``(by, metric, mean, scaled, label)``."""
    long = group_means(df, by, cols, metric_name="metric", value_name="mean")
    return minmax_across_groups(long, by, "metric", "mean")


def transpose(long: DataFrame, index: str, columns: str, value: str, values: Sequence[str]) -> DataFrame:
    """One row per ``index``, one column for each of ``values`` of ``columns``."""
    return long.groupBy(index).pivot(columns, list(values)).agg(F.first(value))
