"""Projection and filters.

Null rule for membership filters: the option lists offered to a user come from
the column's distinct values, which include null, and a selected null keeps the
null rows. Spark's ``isin`` drops nulls, so a selected ``None`` adds
``IS NULL``. An empty selection keeps nothing (P4); :func:`optional_filter`
treats an empty selection as "all" (P5).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member_predicate(col: str, values: Sequence) -> Column:
    """``col`` in ``values``, where a ``None`` in ``values`` matches null."""
    vals = list(values)
    keep_null = any(v is None for v in vals)
    concrete = [v for v in vals if v is not None]
    pred = F.col(col).isin(concrete) if concrete else F.lit(False)
    if keep_null:
        pred = pred | F.col(col).isNull()
    return F.coalesce(pred, F.lit(False))


def selection_predicate(selections: Mapping[str, Sequence]) -> Column:
    pred = F.lit(True)
    for col, values in selections.items():
        pred = pred & member_predicate(col, values)
    return pred


def filter_members(df: DataFrame, selections: Mapping[str, Sequence]) -> DataFrame:
    """AND of membership filters, one per column."""
    return df.where(selection_predicate(selections))


def optional_filter(df: DataFrame, col: str, values: Sequence | None) -> DataFrame:
    """P5: an empty or missing selection means every row."""
    if not values:
        return df
    return df.where(member_predicate(col, values))


def filtered_counts(df: DataFrame, selections: Mapping[str, Sequence]) -> DataFrame:
    """Rows shown after the filter and rows in total, in one pass."""
    return df.agg(F.count_if(selection_predicate(selections)).alias("n_shown"),
                  F.count(F.lit(1)).alias("n_total"))


def is_empty(df: DataFrame) -> bool:
    """S3: true when the (filtered) input has no row."""
    return df.isEmpty()


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of ``col`` including null, sorted (null last)."""
    return df.select(col).distinct().orderBy(F.col(col).asc_nulls_last())


def distinct_options(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P12 for several columns, long form ``(dimension, value)``."""
    out = None
    for c in cols:
        part = df.select(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def predicate_counts(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """Count of rows meeting each named predicate (null counts as false), one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count_if(F.coalesce(p, F.lit(False))).alias(name) for name, p in predicates.items()])
