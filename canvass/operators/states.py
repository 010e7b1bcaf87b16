"""Partial states for interactive filters (A8, A11, A13 under any P4 selection).

A dashboard that filters by segment and emirate asks the same tables of the same
rows again and again. One scan with grouping sets gives a small table: for each
pair of filter values, alone and with each value of a category, the counts,
sums and sketches that the tables are made of. Any selection is then a filter
and a roll-up of that table; no row of the survey is read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.labels import title_label
from canvass.operators.clean import number
from canvass.operators.crosstab import cells
from canvass.operators.profile import scoped, share
from canvass.operators.select import selection_predicate
from canvass.operators.sketch import SKETCH_K
from canvass.plans.joins import stored
from canvass.sources.schema import PAIN_COLS, TECH_COLS

FILTERS = ("segment", "primary_emirate")
CATEGORIES = ("adoption_class", "commercial_model", "summer_cooling_spike")
MEANS = ("hvac_pct_of_bill", *PAIN_COLS, *TECH_COLS)
MEDIANS = ("wtp_aed_per_building", "monthly_bill_aed")


def partial_states(df: DataFrame, filters: Sequence[str] = FILTERS, categories: Sequence[str] = CATEGORIES, means: Sequence[str] = MEANS,
                   medians: Sequence[str] = MEDIANS, high_class: str = "High-Intent Buyer", eval_class: str = "Evaluator",
                   pilot_min: int = 4, k: int = SKETCH_K) -> DataFrame:
    """The written table of states: the ``filters``, category and value (both
    null in the rows over all categories), n, the KPI counts, n_ and sum_ of each
    of ``means``, and sketch_ of each of ``medians``.

    Nulls are values of filters and categories like others; nulls and NaN are no
    part of sums and sketches. Its rows are bounded by the values' combinations."""
    f, c = list(filters), list(categories)
    rows = df.select(*f, *c, (F.col("pilot_interest") >= pilot_min).alias("_pilot"), F.col("adoption_class").alias("_class"),
                     *[number(x).alias(f"_m_{x}") for x in means], *[number(x).alias(f"_q_{x}") for x in medians])
    sets = [[F.col(x) for x in f], *[[F.col(x) for x in (*f, one)] for one in c]]
    grouped = rows.groupingSets(sets, *[F.col(x) for x in (*f, *c)]).agg(
        *[F.grouping(x).alias(f"_g_{x}") for x in c],
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_class") == high_class).alias("n_high_intent"),
        F.count_if(F.col("_class") == eval_class).alias("n_evaluator"), F.count_if("_pilot").alias("n_pilot"),
        *[F.count(f"_m_{x}").alias(f"n_{x}") for x in means], *[F.sum(f"_m_{x}").alias(f"sum_{x}") for x in means],
        *[F.kll_sketch_agg_double(f"_q_{x}", k).alias(f"sketch_{x}") for x in medians])
    category = F.coalesce(*[F.when(F.col(f"_g_{x}") == 0, F.lit(x)) for x in c]) if c else F.lit(None).cast("string")
    value = F.coalesce(*[F.when(F.col(f"_g_{x}") == 0, F.col(x).cast("string")) for x in c]) if c else F.lit(None).cast("string")
    others = [x for x in grouped.columns if x not in (*f, *c) and not x.startswith("_g_")]
    return stored(grouped.select(*f, category.alias("category"), value.alias("value"), *others), "states")


def _selected(states: DataFrame, selections: Mapping[str, Sequence], category: str | None) -> DataFrame:
    of = F.col("category").isNull() if category is None else F.col("category") == category
    return states.where(of & selection_predicate(selections))


def kpi_row(states: DataFrame, selections: Mapping[str, Sequence] | None = None, by=None, probs: float = 0.5) -> DataFrame:
    """A8 of the selected rows: counts, shares and the mean exact, the two medians from merged sketches."""
    data, keys = scoped(_selected(states, selections or {}, None), by)
    total = data.groupBy(*keys).agg(
        *[F.sum(x).alias(y) for x, y in (("n", "respondents"), ("n_high_intent", "n_high_intent"), ("n_evaluator", "n_evaluator"), ("n_pilot", "n_pilot"))],
        F.try_divide(F.sum("sum_hvac_pct_of_bill"), F.sum("n_hvac_pct_of_bill")).alias("hvac_avg"),
        *[F.kll_merge_agg_double(f"sketch_{x}").alias(f"sketch_{x}") for x in MEDIANS])
    median = lambda x: F.when(F.kll_sketch_get_n_double(f"sketch_{x}") > 0, F.kll_sketch_get_quantile_double(f"sketch_{x}", F.lit(float(probs))))
    return total.select(
        *keys, "respondents", "n_high_intent", "n_evaluator", "n_pilot",
        *[share(F.col(x), F.col("respondents")).alias(y) for x, y in (
            ("n_high_intent", "high_intent_pct"), ("n_evaluator", "evaluator_pct"), ("n_pilot", "pilot_pct"))],
        median("wtp_aed_per_building").alias("median_wtp"), median("monthly_bill_aed").alias("median_bill"), "hvac_avg")


def crosstab(states: DataFrame, row: str, col: str, selections: Mapping[str, Sequence] | None = None, percent: bool = True) -> DataFrame:
    """A11 of the selected rows, for a filter column by a category."""
    kept = _selected(states, selections or {}, col).where(F.col(row).isNotNull() & F.col("value").isNotNull())
    return cells(kept.groupBy(row, F.col("value").alias(col)).agg(F.sum("n").alias("n")), row, col, percent)


def group_means(states: DataFrame, by: str, cols: Sequence[str], selections: Mapping[str, Sequence] | None = None, prefix: str = "") -> DataFrame:
    """A13 of the selected rows, by a filter column: (by, item, rate, label)."""
    kept = _selected(states, selections or {}, None).where(F.col(by).isNotNull())
    wide = kept.groupBy(by).agg(*[F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}")).alias(c) for c in cols])
    return wide.unpivot([by], list(cols), "item", "rate").withColumn("label", title_label("item", prefix))
