"""The dashboard's seven pages as dictionaries of result DataFrames.

Scoping follows the dashboard: pages 1-3 and the first two tables of page 6
use the globally filtered view; clusters, classification, the lead table,
the price regression and the rules use the whole table. Filters are
arguments; an empty global selection keeps no rows, an empty page-3 segment
selection keeps all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from canvass.operators import (basket, cluster, crosstab, distribution, evaluate, leads, price, profile,
                               propensity, scenario, select)
from canvass.plans.joins import stored
from canvass.sources.schema import CLUSTER_FEATURES, PAIN_COLS, PROFILE_COLS, SEGMENTS, SPIKE_ORDER, TECH_COLS


def selections(segments: Sequence | None = None, emirates: Sequence | None = None) -> dict:
    """The sidebar selection; ``None`` means no filter on that column."""
    sel = {}
    if segments is not None:
        sel["segment"] = segments
    if emirates is not None:
        sel["primary_emirate"] = emirates
    return sel


def global_view(df: DataFrame, segments: Sequence | None = None, emirates: Sequence | None = None) -> DataFrame:
    """The sidebar filter (P4): listed values only, a listed ``None`` keeps nulls."""
    sel = selections(segments, emirates)
    return select.filter_members(df, sel) if sel else df


def executive_summary(df: DataFrame, segments: Sequence | None = None,
                      emirates: Sequence | None = None) -> dict[str, DataFrame]:
    view = global_view(df, segments, emirates)
    return {
        "counts": select.filtered_counts(df, selections(segments, emirates)),
        "kpi": profile.kpi_row(view),
        "adoption_split": profile.frequency(view, "adoption_class"),
        "segments": profile.frequency(view, "segment"),
        "adoption_by_segment": crosstab.crosstab(view, "segment", "adoption_class"),
    }


def energy_landscape(view: DataFrame) -> dict[str, DataFrame]:
    return {
        "bill_histogram": distribution.histogram(view, "monthly_bill_aed", 50, scale=1000.0),
        "bill_summary": profile.summary(view, ["monthly_bill_aed", "hvac_pct_of_bill"]),
        "hvac_histogram": distribution.histogram(view, "hvac_pct_of_bill", 35),
        "savings": profile.savings_estimate(view),
        "bill_box": distribution.box_stats(view, "monthly_bill_aed", "segment", scale=1000.0),
        "spike_by_emirate": crosstab.crosstab_wide(view, "primary_emirate", "summer_cooling_spike", SPIKE_ORDER),
        "quadrants": profile.quadrants(view),
    }


def segmentation(view: DataFrame, segments: Sequence | None = None) -> dict[str, DataFrame]:
    dfs = select.optional_filter(view, "segment", segments)
    prof = crosstab.score_profile(dfs, "segment", PROFILE_COLS)
    return {
        "pain": crosstab.group_means(dfs, "segment", PAIN_COLS, "pain_"),
        "tech": crosstab.group_means(dfs, "segment", TECH_COLS, "tech_"),
        "commercial_model": crosstab.crosstab(dfs, "segment", "commercial_model"),
        "score_profile": prof,
        "score_profile_by_metric": crosstab.transpose(prof, "metric", "segment", "scaled", segments or SEGMENTS),
        "median_wtp": _median_wtp(dfs),
    }


def _median_wtp(dfs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    from canvass.functions.labels import money
    from canvass.operators.quantile import quantiles
    q = quantiles(dfs, ["wtp_aed_per_building"], [0.5], ["segment"])
    return q.select("segment", F.col("value").alias("median_wtp"), money("value").alias("median_wtp_label")) \
        .orderBy(F.col("median_wtp").asc_nulls_last(), "segment")


def clusters(df: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    vec = cluster.with_vector(cluster.scaled_matrix(df, CLUSTER_FEATURES), CLUSTER_FEATURES)
    vec = stored(vec, "cluster-matrix")
    fits = cluster.kmeans_shared(vec, sorted({*range(2, 10), k}))
    fit = fits[k]
    pca = cluster.fit_pca(vec, CLUSTER_FEATURES)
    assigned = cluster.assign(fit, vec)
    return {
        "elbow": cluster.elbow_of(vec, {j: f for j, f in fits.items() if j in range(2, 10)}),
        "silhouette": evaluate.silhouette_sq_euclidean(assigned, "cluster", "features"),
        "silhouette_euclidean": silhouette.silhouette_euclidean(assigned, "cluster", "features", "respondent_id"),
        "points": cluster.project(assigned, pca, ["respondent_id", "cluster", "cluster_name"]),
        "centroids": cluster.project(cluster.centroids(fit, CLUSTER_FEATURES), pca, ["cluster", "cluster_name"]),
        "variance": cluster.variance_table(pca),
    }


def classification(df: DataFrame, lead_classes: Sequence[str] = ("High-Intent Buyer",)) -> dict[str, DataFrame]:
    rf = propensity.fit_forest(df)
    return {
        "cv_macro_f1": rf.cv_metrics,
        "importances": leads.ranked_values(rf.importances, "feature", "importance", 12),
        "confusion": evaluate.confusion(rf.test_predictions, "actual", "predicted"),
        "report": evaluate.classification_report(rf.test_predictions, "actual", "predicted"),
        "leads": leads.lead_table(df, lead_classes),
    }


def revenue(df: DataFrame, view: DataFrame, pilot_acceptance: float | None = None) -> dict[str, DataFrame]:
    """Page 6. The scenario grid uses the observed share of would-be pilots
    unless a fixed ``pilot_acceptance`` (the calculator's constant) is given."""
    gb = price.fit_boosting(df)
    if pilot_acceptance is None:
        acc = scenario.observed_acceptance(df)
    else:
        acc = df.sparkSession.createDataFrame([("all", float(pilot_acceptance))], "scope string, acceptance double")
    return {
        "wtp_box": distribution.box_stats(view, "wtp_aed_per_building", "segment"),
        "wtp_histogram_by_class": distribution.histogram(view, "wtp_aed_per_building", 30, by="adoption_class"),
        "scenarios": scenario.scenario_grid(acc),
        "scenarios_by_segment": scenario.scenario_by_segment(df),
        "metrics": evaluate.regression_metrics(gb.test_predictions),
        "importances": leads.ranked_values(gb.importances, "feature", "importance", 10),
        "actual_vs_predicted": evaluate.actual_vs_predicted(gb.test_predictions, "respondent_id"),
    }


def rules(df: DataFrame, min_support: float = 0.15, min_lift: float = 1.2, top: int = 20,
          display_lift: float = 1.2) -> dict[str, DataFrame]:
    sets = basket.frequent_itemsets(basket.basket(df), min_support)
    all_rules = basket.association_rules(sets, min_lift)
    best = basket.top_rules(all_rules, top)
    return {
        "itemsets": sets,
        "rules": all_rules,
        "top": best,
        "summary": basket.rules_summary(best, f"top{top}"),
        "table": basket.rules_table(best, display_lift),
    }
