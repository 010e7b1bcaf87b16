"""Cleaning: median imputation and feature matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators.quantile import median_values
from canvass.sources.schema import IMPUTED_AT_LOAD


def present_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The subset of ``cols`` that exists in ``df``."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def number(col: str):
    """A column as double, with NaN as missing."""
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


def impute_median(df: DataFrame, cols: Sequence[str] = IMPUTED_AT_LOAD) -> DataFrame:
    """Fill nulls and NaN of ``cols`` (those present) with each column's exact median.

    Medians come from one distributed quantile job over the whole input. An
    imputed column becomes double (as pandas' ``fillna`` on an int column with
    gaps). A column with no value at all stays null.
    """
    cols = present_columns(df, cols)
    if not cols:
        return df
    return fill_values(df, median_values(df, cols))


def fill_values(df: DataFrame, values: dict) -> DataFrame:
    """Fill nulls and NaN of each column with its value (columns become double);
    a ``None`` value leaves the column's gaps as nulls."""
    return df.withColumns({
        c: (F.coalesce(number(c), F.lit(v)) if v is not None else number(c))
        for c, v in values.items() if c in df.columns
    })


def feature_matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("respondent_id",)
                   ) -> DataFrame:
    """Features cast to double and median-imputed; ``keep`` columns ride along.

    One aggregation counts each feature's gaps (nulls and NaN); medians are
    computed only for features that have some. Raises ``ValueError`` when a feature has no value at all (its median is
    undefined), instead of silently leaving nulls in a model input.
    """
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    row = df.agg(F.count(F.lit(1)), *[F.count(number(c)) for c in features]).first()
    n, filled = row[0], dict(zip(features, row[1:]))
    empty = [c for c in features if n and not filled[c]]
    if empty:
        raise ValueError(f"feature columns without any value: {empty}")
    gaps = [c for c in features if filled[c] < n]
    meds = median_values(df, gaps) if gaps else {}
    return df.select(*keep, *[(F.coalesce(number(c), F.lit(meds[c])) if c in meds else F.col(c).cast("double")).alias(c)
                              for c in features])
