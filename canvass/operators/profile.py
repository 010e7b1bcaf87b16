"""Profiles: KPI rows, frequency tables, summary statistics.

Grouped results take ``by`` columns; with no ``by`` the result has one row
with ``scope = 'all'`` so global and grouped outputs share one join path (an
equi-join on the key, never a cross join). Null group keys are dropped,
as pandas' ``groupby`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.labels import grouped, money, percent_label, thousands_label
from canvass.operators.clean import number
from canvass.operators.quantile import _as_list, long_values, quantiles


def scoped(df: DataFrame, by) -> tuple[DataFrame, list[str]]:
    """Return ``df`` and its group keys; adds ``scope='all'`` when ``by`` is empty."""
    keys = _as_list(by)
    if keys:
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).isNotNull()
        return df.where(cond), keys
    return df.withColumn("scope", F.lit("all")), ["scope"]


def share(num: Column, den: Column) -> Column:
    """A2: ``100 * num / den``; null when the denominator is 0."""
    return F.try_divide(num * F.lit(100.0), den)


def kpi_row(df: DataFrame, by=None, high_class: str = "High-Intent Buyer",
            eval_class: str = "Evaluator", pilot_min: int = 4) -> DataFrame:
    """Respondents, high-intent %, evaluator %, pilot %, median WTP, median bill, mean HVAC %.

    Counts and the mean come from one partial/final aggregation; both medians
    from one distributed quantile job, joined on the group key.
    """
    data, keys = scoped(df, by)
    counts = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("respondents"),
        F.count_if(F.col("adoption_class") == high_class).alias("n_high_intent"),
        F.count_if(F.col("adoption_class") == eval_class).alias("n_evaluator"),
        F.count_if(F.col("pilot_interest") >= pilot_min).alias("n_pilot"),
        F.avg(number("hvac_pct_of_bill")).alias("hvac_avg"),
    )
    q = quantiles(data, ["wtp_aed_per_building", "monthly_bill_aed"], [0.5], keys)
    meds = q.groupBy(*keys).agg(
        F.max(F.when(F.col("metric") == "wtp_aed_per_building", F.col("value"))).alias("median_wtp"),
        F.max(F.when(F.col("metric") == "monthly_bill_aed", F.col("value"))).alias("median_bill"),
    )
    # Both sides are aggregates on the same keys (one row per group).
    out = counts.join(meds, keys, "left")
    return out.select(
        *keys, "respondents", "n_high_intent", "n_evaluator", "n_pilot",
        share(F.col("n_high_intent"), F.col("respondents")).alias("high_intent_pct"),
        share(F.col("n_evaluator"), F.col("respondents")).alias("evaluator_pct"),
        share(F.col("n_pilot"), F.col("respondents")).alias("pilot_pct"),
        "median_wtp", "median_bill", "hvac_avg",
        grouped("respondents", 0).alias("respondents_label"),
        percent_label(share(F.col("n_high_intent"), F.col("respondents"))).alias("high_intent_label"),
        percent_label(share(F.col("n_evaluator"), F.col("respondents"))).alias("evaluator_label"),
        percent_label(share(F.col("n_pilot"), F.col("respondents"))).alias("pilot_label"),
        money("median_wtp").alias("median_wtp_label"),
        thousands_label("median_bill").alias("median_bill_label"),
    )


def frequency(df: DataFrame, col: str) -> DataFrame:
    """Counts per non-null value, with both share denominators.

    ``pct_counted`` divides by the counted (non-null) rows, as a pie chart of
    ``value_counts`` does; ``pct_all`` divides by all rows, nulls included, as
    the bar labels do. One pass over the rows; both totals come from the
    aggregated counts. Sorted by count descending, then value.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.sum(F.when(F.col(col).isNotNull(), F.col("n"))).alias("counted"))
    return counts.where(F.col(col).isNotNull()).select(
        col, "n",
        share(F.col("n"), total.select("counted").scalar()).alias("pct_counted"),
        share(F.col("n"), total.select("all").scalar()).alias("pct_all"),
    ).orderBy(F.col("n").desc(), F.col(col))


def skewness_unbiased(x: str) -> Column:
    """A5: bias-corrected sample skewness (pandas ``skew``); null below 3
    values, 0 if all are equal."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return F.when(n >= 3, F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def summary(df: DataFrame, cols: Sequence[str], by=None, upper_q: float = 0.85) -> DataFrame:
    """Per metric (and group) n, mean, median, skewness, quantile ``upper_q``, min, max.

    Moments come from one aggregation over the unpivoted values; the two exact
    quantiles from one distributed quantile job.
    """
    data, keys = scoped(df, by)
    long = long_values(data, cols, keys)
    gk = keys + ["metric"]
    moments = long.groupBy(*gk).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), skewness_unbiased("x").alias("skew"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    q = quantiles(data, cols, [0.5, upper_q], keys).groupBy(*gk).agg(
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == upper_q, F.col("value"))).alias("q_upper"))
    return moments.join(q, gk, "left").select(
        *gk, "n", "mean", "median", "skew", "q_upper", "min", "max")


def savings_estimate(df: DataFrame, bill_col: str = "monthly_bill_aed", hvac_share: float = 0.679,
                     saving_rate: float = 0.25, by=None) -> DataFrame:
    """Median bill x HVAC share x saving rate, with a ``AED 33k`` label."""
    data, keys = scoped(df, by)
    med = quantiles(data, [bill_col], [0.5], keys).select(*keys, F.col("value").alias("median_bill"))
    saving = F.col("median_bill") * F.lit(hvac_share) * F.lit(saving_rate)
    return med.select(*keys, "median_bill", F.lit(hvac_share).alias("hvac_share"),
                      F.lit(saving_rate).alias("saving_rate"), saving.alias("monthly_saving"),
                      thousands_label(saving).alias("monthly_saving_label"))


# Quadrant names of the prospect map (the reference labels only
# the high/high corner "Prime Targets"; the other three are our names).
QUADRANT_NAMES = {"hh": "Prime Target", "hl": "High Bill, Low WTP",
                  "lh": "Low Bill, High WTP", "ll": "Low Priority"}


def quadrants(df: DataFrame, x_col: str = "monthly_bill_aed", y_col: str = "wtp_aed_per_building",
              id_col: str = "respondent_id", names: dict | None = None,
              upper_q: float = 0.85) -> DataFrame:
    """Each row against the global medians of ``x_col`` and ``y_col``.

    "High" is strictly above the median; a row with either value missing has
    a null quadrant. The medians (and the ``upper_q``
    quantile of ``y``, where the chart puts its label) are three numbers from
    one distributed quantile job, then literals in the row-wise plan.
    """
    names = names or QUADRANT_NAMES
    q = quantiles(df, [x_col, y_col], [0.5, upper_q]).collect()
    vals = {(r["metric"], r["p"]): r["value"] for r in q}
    mx, my = vals.get((x_col, 0.5)), vals.get((y_col, 0.5))
    qy = vals.get((y_col, upper_q))
    hx = F.col(x_col) > F.lit(mx)
    hy = F.col(y_col) > F.lit(my)
    missing = F.col(x_col).isNull() | F.col(y_col).isNull() | F.isnan(F.col(x_col).cast("double")) | F.isnan(F.col(y_col).cast("double"))
    label = (F.when(missing, None).when(hx & hy, names["hh"]).when(hx, names["hl"]).when(hy, names["lh"])
             .otherwise(names["ll"]))
    return df.select(id_col, "segment", x_col, y_col,
                     F.lit(mx).cast("double").alias("x_median"), F.lit(my).cast("double").alias("y_median"),
                     F.lit(qy).cast("double").alias("y_upper_quantile"), label.alias("quadrant"))


def quadrant_counts(points: DataFrame, by: str = "segment") -> DataFrame:
    """Respondents per group x quadrant, with the share of the group."""
    counts = points.where(F.col(by).isNotNull() & F.col("quadrant").isNotNull()).groupBy(by, "quadrant").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    tot = F.sum("n").over(Window.partitionBy(by))
    return counts.select(by, "quadrant", "n", share(F.col("n"), tot).alias("pct_of_group"))
