"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the supplied tables through :func:`responses` (or another
table) and runs the library operator over all of it. Doubles that come from
sums, averages or interpolation are rounded to 6 places here and in the
oracle SQL so both engines produce the same numbers despite different
summation orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.functions import labels as L
from canvass.operators import basket, clean, crosstab, distribution, evaluate, leads, profile, scenario, select
from canvass.operators import silhouette, sketch, split, states
from canvass.operators.quantile import quantiles
from canvass.plans import reuse
from canvass.plans.joins import stored
from canvass.session import scratch_path
from canvass.sources import io
from canvass.sources.fixtures import embeddings_long, responses, table
from canvass.sources.schema import (CLUSTER_FEATURES, IMPUTED_AT_LOAD, PAIN_COLS, PROFILE_COLS,
                                    RESPONSE_COLUMNS, SEGMENTS, SPIKE_ORDER, TECH_COLS)

R6 = 6

# Lift of the rule table query: it keeps some of the top 20 rules and drops others.
RULES_DISPLAY_LIFT = 1.385

# The selections used by the filter queries (fixture categories).
SEGMENT_PICK = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
EMIRATE_PICK = ["AMERICA", "ASIA", "EUROPE"]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, R6)


def _round_doubles(df: DataFrame, skip=()) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" and f.name not in skip
                       else F.col(f.name) for f in df.schema.fields])


_INPUTS = ("lineitem", "part", "orders", "customer", "nation", "region")


def _inputs(sf_dir: str) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in _INPUTS]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey table before imputation (the written copy when the manifest has one of just
    these input files). Queries that read none of the imputed columns start here, so they need no median."""
    hit = reuse.find(spark, "responses", _inputs(sf_dir))
    return hit[0] if hit else responses(spark, sf_dir)


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + P8: the survey table as the dashboard loads it (three medians imputed).

    When :func:`materialize` wrote the table for these input files, in this session or
    another one, it is read back and the stored medians are applied as literals.
    """
    hit = reuse.find(spark, "responses", _inputs(sf_dir))
    if hit:
        return clean.fill_values(*hit)
    return clean.impute_median(responses(spark, sf_dir), IMPUTED_AT_LOAD)


def materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the survey table once into the shared folder; later queries and sessions read it.

    The table is written raw (one pass over the joins), the three load-time
    medians are computed from the written parquet (a scan of three columns),
    and applied lazily on every read. A table made from other files, or from these
    before they were rewritten, is never taken (:mod:`canvass.plans.reuse`).
    """
    return reuse.keep(spark, "responses", _inputs(sf_dir), lambda: responses(spark, sf_dir),
                      lambda table_: clean.median_values(table_, IMPUTED_AT_LOAD))[0]


# ---------------------------------------------------------------- sources, filters
def q_csv_roundtrip(spark, sf_dir):
    df = raw(spark, sf_dir)
    path = io.write_csv(df)
    return io.read_responses(spark, path, fmt="csv")


def q_csv_reordered(spark, sf_dir):
    """A file whose columns stand in another order, with one that isn't declared."""
    df = raw(spark, sf_dir)
    path = io.write_csv(df.select(F.lit("x").alias("note"), *reversed(df.columns)))
    return io.read_responses(spark, path, fmt="csv")


def q_csv_quarantine(spark, sf_dir):
    """A file with unreadable bills and records with a surplus field: rows kept, and set apart by reason."""
    df = raw(spark, sf_dir)
    k = F.col("respondent_id")
    texts = df.withColumn("monthly_bill_aed", F.when(k % 97 == 0, F.lit("n.k.")).otherwise(F.col("monthly_bill_aed").cast("string")))
    line = F.concat(F.to_csv(F.struct(*texts.columns)), F.when(k % 89 == 0, F.lit(",surplus")).otherwise(F.lit("")))
    path = scratch_path(spark, "csv-bad")
    # a line is one column, its header the names: tabs never occur, so nothing is quoted
    texts.select(line.alias(",".join(texts.columns))).write.option("header", True).option("sep", "\t").csv(path)
    good, bad = io.read_quarantined(spark, path)
    kept = good.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n"), F.sum("respondent_id").alias("ids"))
    first = F.get(F.split("record", ","), F.lit(0)).cast("long")
    return kept.unionByName(bad.groupBy(F.array_join("reasons", ",").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("ids")))


def q_distinct_options(spark, sf_dir):
    return select.distinct_options(raw(spark, sf_dir),
                                   ["segment", "primary_emirate", "summer_cooling_spike"])


def q_filtered_counts(spark, sf_dir):
    return select.filtered_counts(raw(spark, sf_dir),
                                  {"segment": SEGMENT_PICK, "primary_emirate": EMIRATE_PICK})


def q_filter_null_member(spark, sf_dir):
    df = raw(spark, sf_dir).withColumn(
        "segment", F.when(F.col("segment") != "MACHINERY", F.col("segment")))
    kept = select.filter_members(df, {"segment": ["AUTOMOBILE", None], "summer_cooling_spike":
                                      ["<20%", ">100%", None]})
    return kept.groupBy("segment", "summer_cooling_spike").agg(F.count(F.lit(1)).alias("n"))


def q_optional_filter(spark, sf_dir):
    df = raw(spark, sf_dir)
    every = select.optional_filter(df, "segment", []).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n")).withColumn("selection", F.lit("empty"))
    some = select.optional_filter(df, "segment", SEGMENT_PICK).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n")).withColumn("selection", F.lit("picked"))
    return every.unionByName(some)


def q_impute_median(spark, sf_dir):
    return loaded(spark, sf_dir).select("respondent_id", *IMPUTED_AT_LOAD)


def q_feature_matrix_imputed(spark, sf_dir):
    return clean.feature_matrix(raw(spark, sf_dir), CLUSTER_FEATURES)


def q_predicate_counts(spark, sf_dir):
    df = raw(spark, sf_dir)
    return select.predicate_counts(df, {
        "n_high_intent": F.col("adoption_class") == "High-Intent Buyer",
        "n_pilot": F.col("pilot_interest") >= 4,
        "n_big_bill": F.col("monthly_bill_aed") >= 200000,
        "n_spike_null": F.col("summer_cooling_spike").isNull(),
        "n_spike_eq": F.col("summer_cooling_spike") == ">100%",
    })


def q_scalar_labels(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select(
        "respondent_id",
        L.money("wtp_aed_per_building").alias("wtp_label"),
        L.thousands_label("monthly_bill_aed").alias("bill_k_label"),
        L.millions_label(F.col("monthly_bill_aed") * 100).alias("bill_m_label"),
        L.percent_label("hvac_pct_of_bill").alias("hvac_label"),
        r6(F.col("monthly_bill_aed") / 1000).alias("bill_k"),
        r6(F.log1p("wtp_aed_per_building")).alias("log_wtp"),
        L.prefix(L.item_label(F.concat(F.lit("tech_"), F.lower("building_type"))), 12).alias("item_prefix"),
        L.title_label(F.lit("pain_high_cost"), "pain_").alias("pain_title"),
        L.truncate_to_long(F.col("monthly_bill_aed") / 1000).alias("bill_k_int"),
        L.lookup(F.col("realtime_visibility_score") % 5, {0: "C0", 1: "C1", 2: "C2", 3: "C3", 4: "C4"})
        .alias("code_name"),
    )


# ---------------------------------------------------------------- profiles
def q_kpi_row(spark, sf_dir):
    return _round_doubles(profile.kpi_row(raw(spark, sf_dir), "segment"))


def q_kpi_row_all(spark, sf_dir):
    df = select.filter_members(raw(spark, sf_dir), {"segment": SEGMENT_PICK, "primary_emirate": EMIRATE_PICK})
    return _round_doubles(profile.kpi_row(df))


def q_share_of_total(spark, sf_dir):
    df = raw(spark, sf_dir)
    a = profile.frequency(df, "summer_cooling_spike").withColumnRenamed("summer_cooling_spike", "value") \
        .withColumn("dimension", F.lit("summer_cooling_spike"))
    b = profile.frequency(df, "adoption_class").withColumnRenamed("adoption_class", "value") \
        .withColumn("dimension", F.lit("adoption_class"))
    c = profile.frequency(df, "segment").withColumnRenamed("segment", "value") \
        .withColumn("dimension", F.lit("segment"))
    return _round_doubles(a.unionByName(b).unionByName(c))


def q_bill_summary(spark, sf_dir):
    return _round_doubles(profile.summary(raw(spark, sf_dir),
                                          ["monthly_bill_aed", "wtp_aed_per_building", "hvac_pct_of_bill"]))


def q_savings_estimate(spark, sf_dir):
    return _round_doubles(profile.savings_estimate(raw(spark, sf_dir)))


def q_prospect_quadrants(spark, sf_dir):
    return _round_doubles(profile.quadrants(raw(spark, sf_dir)))


def q_quadrant_counts(spark, sf_dir):
    return _round_doubles(profile.quadrant_counts(profile.quadrants(raw(spark, sf_dir))))


# ---------------------------------------------------------------- crosstabs, profiles by group
def q_crosstab_adoption(spark, sf_dir):
    return _round_doubles(crosstab.crosstab(raw(spark, sf_dir), "segment", "adoption_class"))


def q_crosstab_model(spark, sf_dir):
    return _round_doubles(crosstab.crosstab(raw(spark, sf_dir), "segment", "commercial_model"))


def q_crosstab_spike(spark, sf_dir):
    return _round_doubles(crosstab.crosstab_wide(raw(spark, sf_dir), "primary_emirate",
                                                 "summer_cooling_spike", SPIKE_ORDER))


def q_pain_prevalence(spark, sf_dir):
    return _round_doubles(crosstab.group_means(raw(spark, sf_dir), "segment", PAIN_COLS, "pain_"))


def q_tech_deployment(spark, sf_dir):
    return _round_doubles(crosstab.group_means(raw(spark, sf_dir), "segment", TECH_COLS, "tech_"))


def q_score_profile_scaled(spark, sf_dir):
    return _round_doubles(crosstab.score_profile(loaded(spark, sf_dir), "segment", PROFILE_COLS))


def q_score_profile_transposed(spark, sf_dir):
    prof = crosstab.score_profile(loaded(spark, sf_dir), "segment", PROFILE_COLS)
    return _round_doubles(crosstab.transpose(prof, "metric", "segment", "scaled", SEGMENTS))


def q_wtp_median_by_segment(spark, sf_dir):
    q = quantiles(raw(spark, sf_dir), ["wtp_aed_per_building"], [0.5], ["segment"])
    out = q.select("segment", F.col("value").alias("median_wtp"), L.money("value").alias("median_wtp_label"))
    return _round_doubles(out).orderBy(F.col("median_wtp").asc_nulls_last(), "segment")


# ---------------------------------------------------------------- distributions
def q_hist_bill(spark, sf_dir):
    return _round_doubles(distribution.histogram(raw(spark, sf_dir), "monthly_bill_aed", 50, scale=1000.0))


def q_hist_share(spark, sf_dir):
    return _round_doubles(distribution.histogram(raw(spark, sf_dir), "hvac_pct_of_bill", 35))


def q_hist_wtp_by_class(spark, sf_dir):
    return _round_doubles(distribution.histogram(raw(spark, sf_dir), "wtp_aed_per_building", 30,
                                                 by="adoption_class"))


def q_box_bill(spark, sf_dir):
    return _round_doubles(distribution.box_stats(raw(spark, sf_dir), "monthly_bill_aed", "segment",
                                                 scale=1000.0))


def q_box_wtp(spark, sf_dir):
    return _round_doubles(distribution.box_stats(raw(spark, sf_dir), "wtp_aed_per_building", "segment"))


def q_box_outliers(spark, sf_dir):
    return _round_doubles(distribution.box_outliers(raw(spark, sf_dir), "wtp_aed_per_building", "segment"))


# ---------------------------------------------------------------- leads
def q_lead_table(spark, sf_dir):
    return leads.lead_table(raw(spark, sf_dir))


# ---------------------------------------------------------------- baskets and rules
def _rules(spark, sf_dir):
    sets = basket.frequent_itemsets(basket.basket(raw(spark, sf_dir)), 0.15)
    return basket.association_rules(sets, 1.2)


def q_basket_items(spark, sf_dir):
    b = basket.basket(raw(spark, sf_dir))
    return b.select("respondent_id", F.explode("items").alias("item"))


def q_frequent_itemsets(spark, sf_dir):
    sets = basket.frequent_itemsets(basket.basket(raw(spark, sf_dir)), 0.15)
    return _round_doubles(sets.drop("items"))


def q_rules_top20(spark, sf_dir):
    top = basket.top_rules(_rules(spark, sf_dir), 20)
    return _round_doubles(top.select("rule_rank", "antecedents", "consequents", "support", "confidence", "lift"))


def q_rules_summary(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    top = basket.top_rules(rules, 20)
    return _round_doubles(basket.rules_summary(top, "top20").unionByName(basket.rules_summary(rules, "all")))


def q_rules_min_lift(spark, sf_dir):
    return basket.rules_table(basket.top_rules(_rules(spark, sf_dir), 20), RULES_DISPLAY_LIFT)


def q_rules_all(spark, sf_dir):
    return _round_doubles(_rules(spark, sf_dir).drop("antecedent_items", "consequent_items"))


# ---------------------------------------------------------------- scenarios
def q_scenario_grid(spark, sf_dir):
    acc = scenario.observed_acceptance(raw(spark, sf_dir))
    return _round_doubles(scenario.scenario_grid(acc))


def q_scenario_by_segment(spark, sf_dir):
    return _round_doubles(scenario.scenario_by_segment(raw(spark, sf_dir)))


# ---------------------------------------------------------------- labels, splits, metrics
def fixed_rule():
    """A deterministic stand-in prediction so metric code has an exact oracle."""
    return (F.when(F.col("pilot_interest") >= 4, "High-Intent Buyer")
            .when(F.col("pilot_interest") >= 2, "Evaluator").otherwise("Not Ready"))


def q_label_encode(spark, sf_dir):
    from canvass.operators import propensity
    return propensity.label_encode(raw(spark, sf_dir), "adoption_class").select(
        "respondent_id", "adoption_class", "label")


def q_class_weights(spark, sf_dir):
    from canvass.operators import propensity
    return _round_doubles(propensity.class_weights(raw(spark, sf_dir), "adoption_class"))


def q_stratified_split(spark, sf_dir):
    s = split.stratified_split(raw(spark, sf_dir), "adoption_class")
    return s.groupBy("adoption_class", "is_test").agg(F.count(F.lit(1)).alias("n"))


def q_cv_folds(spark, sf_dir):
    f = split.stratified_folds(raw(spark, sf_dir), "adoption_class", folds=5)
    return f.groupBy("adoption_class", "fold").agg(F.count(F.lit(1)).alias("n"))


def q_random_split(spark, sf_dir):
    s = split.random_split(raw(spark, sf_dir))
    return s.select("respondent_id", "is_test")


def _fixed_predictions(spark, sf_dir):
    return raw(spark, sf_dir).select("respondent_id", F.col("adoption_class").alias("label"),
                                        fixed_rule().alias("prediction"))


def q_confusion_fixed_rule(spark, sf_dir):
    return evaluate.confusion(_fixed_predictions(spark, sf_dir))


def q_report_fixed_rule(spark, sf_dir):
    return _round_doubles(evaluate.classification_report(_fixed_predictions(spark, sf_dir)))


def q_macro_f1_fixed_rule(spark, sf_dir):
    return _round_doubles(evaluate.macro_f1(_fixed_predictions(spark, sf_dir)))


def _fixed_regression(spark, sf_dir):
    df = split.random_split(raw(spark, sf_dir)).where("is_test")
    return df.select("respondent_id", F.log1p("wtp_aed_per_building").alias("y"),
                     F.log1p(F.col("monthly_bill_aed") * 0.1).alias("prediction"))


def q_regression_metrics_fixed_rule(spark, sf_dir):
    return _round_doubles(evaluate.regression_metrics(_fixed_regression(spark, sf_dir)))


def q_actual_vs_predicted_fixed_rule(spark, sf_dir):
    return _round_doubles(evaluate.actual_vs_predicted(_fixed_regression(spark, sf_dir), "respondent_id"))


def q_inertia_given_labels(spark, sf_dir):
    return _round_doubles(evaluate.inertia(embeddings_long(spark, sf_dir)))


def q_silhouette_given_labels(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.col("embedding").alias("vec"))
    return _round_doubles(evaluate.silhouette_sq_euclidean(emb))


def _labelled_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").alias("cluster"), F.col("embedding").alias("vec"))


def q_silhouette_euclidean(spark, sf_dir):
    """The dashboard's score (plain distances) of the given labels: points with an id divisible by 50 against all rows."""
    return _round_doubles(silhouette.silhouette_euclidean(_labelled_vectors(spark, sf_dir)))


def q_silhouette_euclidean_points(spark, sf_dir):
    return _round_doubles(silhouette.silhouette_points(_labelled_vectors(spark, sf_dir)))


# ---------------------------------------------------------------- approximate quantiles (A3, A6, A14) and partial states
_SKETCHED = ["monthly_bill_aed", "wtp_aed_per_building"]


def q_approx_quantiles_error(spark, sf_dir):
    """Whether each sketched quantile's rank is as near the wanted one as stated; sketches of emirates merged to segments."""
    df = raw(spark, sf_dir)
    parts = stored(sketch.sketches(df, _SKETCHED, ["segment", "primary_emirate"]), "sketches")
    found = sketch.quantiles_of(sketch.merged(parts, ["segment"]), [0.1, 0.5, 0.85])
    errors = sketch.rank_errors(df, found, _SKETCHED, ["segment"])
    return errors.select("segment", "metric", "p", "n", (F.col("error") <= sketch.RANK_ERROR).alias("within"))


def _states(spark, sf_dir):
    return _reuse(spark, sf_dir, "states", lambda: states.partial_states(raw(spark, sf_dir)))


_PICKED = {"segment": SEGMENT_PICK, "primary_emirate": EMIRATE_PICK}


def q_states_kpi(spark, sf_dir):
    """KPI rows of a selection from the table of states; the medians by how near their ranks are."""
    found = states.kpi_row(_states(spark, sf_dir), _PICKED, "segment")
    medians = found.select("segment", F.lit(0.5).alias("p"), F.col("median_wtp").alias("wtp_aed_per_building"),
                           F.col("median_bill").alias("monthly_bill_aed")).unpivot(["segment", "p"], _SKETCHED, "metric", "value")
    errors = sketch.rank_errors(select.filter_members(raw(spark, sf_dir), _PICKED), medians, _SKETCHED, ["segment"])
    within = errors.groupBy("segment").agg((F.max("error") <= sketch.RANK_ERROR).alias("medians_within"))
    return _round_doubles(found.drop("median_wtp", "median_bill").join(within, "segment"))


def q_states_crosstab(spark, sf_dir):
    return _round_doubles(states.crosstab(_states(spark, sf_dir), "segment", "adoption_class", _PICKED))


def q_states_group_means(spark, sf_dir):
    return _round_doubles(states.group_means(_states(spark, sf_dir), "segment", PAIN_COLS, _PICKED, "pain_"))


# ---------------------------------------------------------------- fitted-model reuse
def _fit_key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """The application, the model and the input files with their times and sizes."""
    return spark.sparkContext.applicationId, sf_dir, str(reuse.fingerprint(spark, _inputs(sf_dir))), name


_FITS: dict[tuple, object] = {}


def _reuse(spark: SparkSession, sf_dir: str, name: str, build):
    """One fit per (application, input files, model) in a session, as the dashboard
    memoises its model functions; a new Spark application or a rewritten input refits."""
    key = _fit_key(spark, sf_dir, name)
    if key not in _FITS:
        _FITS[key] = build()
    return _FITS[key]


def _survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``loaded`` for the model queries: the survey table is joined and written once a session
    (unless the manifest has it), as medians, splits and matrices each read it several times."""
    def build():
        if reuse.find(spark, "responses", _inputs(sf_dir)):
            return loaded(spark, sf_dir)
        return clean.impute_median(stored(responses(spark, sf_dir), "survey"), IMPUTED_AT_LOAD)
    return _reuse(spark, sf_dir, "survey", build)


# ---------------------------------------------------------------- clustering
def _cluster_inputs(spark, sf_dir):
    from canvass.operators import cluster
    def build():
        shown = {f"raw_{c}": c for c in PROFILE_COLS + ["monthly_bill_aed"]}
        scaled = cluster.scaled_matrix(_survey(spark, sf_dir), CLUSTER_FEATURES, keep=shown)
        return stored(cluster.with_vector(scaled, CLUSTER_FEATURES), "cluster-matrix")
    return _reuse(spark, sf_dir, "cluster-matrix", build)


def q_scaled_matrix(spark, sf_dir):
    from canvass.operators import cluster
    return _round_doubles(cluster.scaled_matrix(loaded(spark, sf_dir), CLUSTER_FEATURES))


def _models(spark, sf_dir, ks=range(2, 10)):
    """The best model for each of ``ks``, fitted in shared scans once a session; a model
    doesn't depend on those it is fitted with, so only missing ones are fitted."""
    from canvass.operators import cluster
    fits = _reuse(spark, sf_dir, "kmeans", dict)
    missing = [k for k in ks if k not in fits]
    if missing:
        fits |= cluster.kmeans_shared(_cluster_inputs(spark, sf_dir), missing)
    return {k: fits[k] for k in ks}


def _kmeans(spark, sf_dir):
    from canvass.operators import cluster
    return cluster, _cluster_inputs(spark, sf_dir), _models(spark, sf_dir, [5])[5]


def q_kmeans_assignments(spark, sf_dir):
    cluster, vec, fit = _kmeans(spark, sf_dir)
    pca = cluster.fit_pca(vec, CLUSTER_FEATURES)
    assigned = cluster.assign(fit, vec)
    return _round_doubles(cluster.project(assigned, pca, ["respondent_id", "cluster", "cluster_name"]))


def q_cluster_profile(spark, sf_dir):
    cluster, vec, fit = _kmeans(spark, sf_dir)
    return _round_doubles(cluster.cluster_profile(
        cluster.assign(fit, vec), {c: f"raw_{c}" for c in PROFILE_COLS + ["monthly_bill_aed"]}))


def q_elbow(spark, sf_dir):
    from canvass.operators import cluster
    return _round_doubles(cluster.elbow_of(_cluster_inputs(spark, sf_dir), _models(spark, sf_dir)))


def q_pca_points(spark, sf_dir):
    from canvass.operators import cluster
    vec = _cluster_inputs(spark, sf_dir)
    pca = cluster.fit_pca(vec, CLUSTER_FEATURES)
    return _round_doubles(cluster.project(vec, pca, ["respondent_id"]))


def q_pca_variance(spark, sf_dir):
    from canvass.operators import cluster
    vec = _cluster_inputs(spark, sf_dir)
    return _round_doubles(cluster.variance_table(cluster.fit_pca(vec, CLUSTER_FEATURES)))


def q_pca_centroids(spark, sf_dir):
    cluster, vec, fit = _kmeans(spark, sf_dir)
    pca = cluster.fit_pca(vec, CLUSTER_FEATURES)
    cents = cluster.centroids(fit, CLUSTER_FEATURES)
    return _round_doubles(cluster.project(cents, pca, ["cluster", "cluster_name"]))


def q_silhouette_kmeans(spark, sf_dir):
    cluster, vec, fit = _kmeans(spark, sf_dir)
    assigned = cluster.assign(fit, vec)
    return _round_doubles(evaluate.silhouette_sq_euclidean(assigned, "cluster", "features").withColumn("k", F.lit(5))
                          .withColumn("training_cost", F.lit(fit.cost)))


# ---------------------------------------------------------------- classification
def _forest(spark, sf_dir, cv=False):
    from canvass.operators import propensity
    key = _fit_key(spark, sf_dir, "forest-cvTrue")
    if not cv and key in _FITS:  # the cross-validated result carries the same forest
        return _FITS[key]
    return _reuse(spark, sf_dir, f"forest-cv{cv}",
                  lambda: propensity.fit_forest(_survey(spark, sf_dir), cross_validate=cv))


def q_rf_importances(spark, sf_dir):
    return _round_doubles(leads.ranked_values(_forest(spark, sf_dir).importances, "feature", "importance", 12))


def q_rf_cv_macro_f1(spark, sf_dir):
    return _round_doubles(_forest(spark, sf_dir, cv=True).cv_metrics)


def q_rf_confusion(spark, sf_dir):
    return evaluate.confusion(_forest(spark, sf_dir).test_predictions, "actual", "predicted")


def q_rf_report(spark, sf_dir):
    return _round_doubles(evaluate.classification_report(_forest(spark, sf_dir).test_predictions,
                                                         "actual", "predicted"))


# ---------------------------------------------------------------- regression
def _boost(spark, sf_dir):
    from canvass.operators import price
    return _reuse(spark, sf_dir, "boosting", lambda: price.fit_boosting(_survey(spark, sf_dir)))


def q_gbt_importances(spark, sf_dir):
    return _round_doubles(leads.ranked_values(_boost(spark, sf_dir).importances, "feature", "importance", 10))


def q_gbt_metrics(spark, sf_dir):
    return _round_doubles(evaluate.regression_metrics(_boost(spark, sf_dir).test_predictions))


def q_gbt_actual_vs_predicted(spark, sf_dir):
    return _round_doubles(evaluate.actual_vs_predicted(_boost(spark, sf_dir).test_predictions,
                                                       "respondent_id"))


# ---------------------------------------------------------------- facts that any right fit must meet
def q_kmeans_facts(spark, sf_dir):
    """Rows whose cluster isn't that of the nearest centre (none), and whether the
    fit's cost is the inertia of its clusters about their own means."""
    from pyspark.ml.functions import vector_to_array
    cluster, vec, fit = _kmeans(spark, sf_dir)
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in fit.centers])
    x = vector_to_array(F.col("features"))
    sq = lambda c: F.aggregate(F.zip_with("x", c, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda a, v: a + v)
    far = cluster.assign(fit, vec).select("cluster", x.alias("x")).select("cluster", F.transform(centers, sq).alias("d"))
    own = F.element_at("d", F.col("cluster") + 1)
    assigned = cluster.assign(fit, vec).select(F.col("respondent_id").alias("point_id"), "cluster", F.posexplode(x).alias("dim", "value"))
    inertia = evaluate.inertia(assigned).agg(F.sum("inertia")).scalar()
    return far.agg(F.count(F.lit(1)).alias("n"), F.count_if(own > F.array_min("d") * (1 + 1e-9)).alias("n_not_nearest"),
                   (F.abs(inertia - fit.cost) <= 1e-4 * fit.cost).alias("cost_is_inertia"))


def q_elbow_facts(spark, sf_dir):
    """For each k: rows, whether the cost is the sum of the rows' squared distances to
    the nearest centre, whether no iteration raised it, whether each centre is the
    mean of its members but for the tolerance, and whether the cost is below that of one cluster less."""
    from canvass.operators import cluster, lloyd
    vec, fits = _cluster_inputs(spark, sf_dir), _models(spark, sf_dir)
    rows = None
    for k, fit in sorted(fits.items()):
        near = F.least(*lloyd.squared_distances(fit))
        at = vec.select(lloyd.nearest(fit).alias("c"), near.alias("d"), *CLUSTER_FEATURES)
        per = at.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"), *[F.avg(x).alias(x) for x in CLUSTER_FEATURES])
        off = F.array_min(F.array(*lloyd.squared_distances(fit)))
        falls = all(b <= a * (1 + 1e-9) for a, b in zip(fit.path, fit.path[1:]))
        less = k == min(fits) or fit.cost < fits[k - 1].cost
        row = per.agg(F.lit(k).alias("k"), F.sum("n").alias("n"), (F.abs(F.sum("d") - fit.cost) <= 1e-9 * fit.cost).alias("cost_is_distance"),
                      (F.sum(off) <= 1e-3).alias("centres_are_means"), F.lit(falls).alias("cost_falls"), F.lit(less).alias("below_fewer"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def q_pca_facts(spark, sf_dir):
    """Per component: the loadings' length is 1, and the projected points' variance
    is the share of the total variance that the component explains."""
    from canvass.operators import cluster
    vec = _cluster_inputs(spark, sf_dir)
    pca = cluster.fit_pca(vec, CLUSTER_FEATURES)
    points = cluster.project(vec, pca, ["respondent_id"])
    total = vec.agg(sum((F.var_samp(c) for c in CLUSTER_FEATURES), F.lit(0.0))).scalar()
    rows = None
    for j, w in enumerate(pca.loadings):
        row = points.agg(F.lit(f"PC{j + 1}").alias("component"),
                         (F.abs(F.lit(sum(x * x for x in w)) - 1) < 1e-9).alias("unit_length"),
                         (F.abs(F.var_samp(f"pc{j + 1}") / total - pca.explained[j]) < 1e-6).alias("variance_explained"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def q_rf_test_rows(spark, sf_dir):
    """Test rows per class in the forest's confusion table: those of the stratified split."""
    conf = evaluate.confusion(_forest(spark, sf_dir).test_predictions, "actual", "predicted")
    return conf.groupBy(F.col("actual").alias("adoption_class")).agg(F.sum("n").alias("n"))


def q_gbt_test_rows(spark, sf_dir):
    """The boosting model's test rows and their targets: those of the random split."""
    p = _boost(spark, sf_dir).test_predictions
    return _round_doubles(p.select("respondent_id", F.col("y").alias("log_wtp")))


def q_importance_facts(spark, sf_dir):
    """Features per model, and whether their importances sum to 1."""
    both = _forest(spark, sf_dir).importances.withColumn("model", F.lit("forest")).unionByName(
        _boost(spark, sf_dir).importances.withColumn("model", F.lit("boosting")))
    return both.groupBy("model").agg(F.count(F.lit(1)).alias("n_features"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("sum_is_1"))


# ---------------------------------------------------------------- fitted trees as tables of nodes
def _forest_table(spark, sf_dir):
    from canvass.operators import trees
    return _reuse(spark, sf_dir, "forest-nodes", lambda: trees.of_ensemble(spark, _forest(spark, sf_dir).model))


def _boost_table(spark, sf_dir):
    from canvass.operators import trees
    return _reuse(spark, sf_dir, "boosting-nodes", lambda: trees.of_ensemble(spark, _boost(spark, sf_dir).model))


def q_rf_scored_by_table(spark, sf_dir):
    """Test rows of the forest, and how many of them score otherwise by its node table: none."""
    from pyspark.ml.functions import vector_to_array

    from canvass.operators import trees
    fit = _forest(spark, sf_dir)
    test = fit.matrix.where("is_test")
    ours = trees.class_shares(test, _forest_table(spark, sf_dir), fit.model.numClasses, "respondent_id").withColumnRenamed("prediction", "ours")
    theirs = fit.model.transform(test).select("respondent_id", vector_to_array("probability").alias("p"), "prediction")
    both = theirs.join(ours, "respondent_id", "left")
    off = F.exists(F.zip_with("p", "shares", lambda a, b: F.abs(a - b)), lambda d: d.isNull() | (d > 1e-9))
    # classes that are equally likely but for rounding may be named either way
    other = F.element_at("shares", (F.col("prediction") + 1).cast("int")) < F.array_max("shares") - 1e-9
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ours").isNull() | off | other).alias("n_differ"))


def _differing(theirs, ours):
    """Rows, and how many of them have another prediction in ``ours`` (or none)."""
    both = theirs.join(ours.withColumnRenamed("prediction", "ours"), "respondent_id", "left")
    off = F.col("ours").isNull() | (F.abs(F.col("ours") - F.col("prediction")) > 1e-9)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("n_differ"))


def q_gbt_scored_by_table(spark, sf_dir):
    """Test rows of the boosting model, and how many score otherwise by its node table: none."""
    from canvass.operators import trees
    fit = _boost(spark, sf_dir)
    return _differing(fit.test_predictions, trees.regression_sums(fit.matrix.where("is_test"), _boost_table(spark, sf_dir), "respondent_id"))


def q_importances_by_table(spark, sf_dir):
    """Features per model, and how many importances differ from those of the node table's gains: none."""
    from canvass.operators import trees
    from canvass.sources.schema import CLASSIFIER_FEATURES, REGRESSION_FEATURES
    rows = None
    for name, fit, table_, feats in (("forest", _forest(spark, sf_dir), _forest_table(spark, sf_dir), CLASSIFIER_FEATURES),
                                     ("boosting", _boost(spark, sf_dir), _boost_table(spark, sf_dir), REGRESSION_FEATURES)):
        ours = trees.importances(table_, feats, per_tree=name == "forest").withColumnRenamed("importance", "ours")
        both = fit.importances.join(ours, "feature", "left")
        row = both.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_features"),
                       F.count_if(F.col("ours").isNull() | (F.abs(F.col("ours") - F.col("importance")) > 1e-9)).alias("n_differ"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def _residual_boost(spark, sf_dir):
    from canvass.operators import price
    return _reuse(spark, sf_dir, "residual-boosting", lambda: price.fit_by_residuals(_survey(spark, sf_dir)))


def q_residual_boost_facts(spark, sf_dir):
    """The dashboard's boosting (constant start, every tree at 0.05): rounds, whether none
    raised the training error, test rows, and how many score otherwise by the node table (none)."""
    from canvass.operators import trees
    fit = _residual_boost(spark, sf_dir)
    falls = all(b <= a * (1 + 1e-12) for a, b in zip(fit.losses, fit.losses[1:]))
    table_ = trees.of_trees(spark, fit.trees, fit.step, fit.start)
    scored = _differing(fit.test_predictions, trees.regression_sums(fit.matrix.where("is_test"), table_, "respondent_id"))
    return scored.select(F.lit(len(fit.trees)).cast("long").alias("rounds"), F.lit(falls).alias("loss_falls"), "n", "n_differ")


def q_residual_boost_metrics(spark, sf_dir):
    return _round_doubles(evaluate.regression_metrics(_residual_boost(spark, sf_dir).test_predictions))


# ---------------------------------------------------------------- gaps in the data
def _gappy(spark, sf_dir):
    """The survey with gaps: NaN bills, null WTP values and classes, a constant
    column, and a segment that one commercial model never meets."""
    k = F.col("respondent_id")
    model = F.when((F.col("segment") == "BUILDING") & (F.col("commercial_model") == _DROPPED_MODEL), None).otherwise(F.col("commercial_model"))
    return raw(spark, sf_dir).withColumns({
        "monthly_bill_aed": F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("monthly_bill_aed").cast("double")),
        "wtp_aed_per_building": F.when(k % 11 == 0, None).otherwise(F.col("wtp_aed_per_building")),
        "adoption_class": F.when(k % 5 == 0, None).otherwise(F.col("adoption_class")),
        "commercial_model": model, "constant": F.lit(3.5)})


_DROPPED_MODEL = "3-MEDIUM"


def q_gaps_impute(spark, sf_dir):
    return clean.impute_median(_gappy(spark, sf_dir), ["monthly_bill_aed", "wtp_aed_per_building"]).select(
        "respondent_id", "monthly_bill_aed", "wtp_aed_per_building")


def q_gaps_crosstab(spark, sf_dir):
    return _round_doubles(crosstab.crosstab(_gappy(spark, sf_dir), "segment", "commercial_model"))


def q_gaps_group_means(spark, sf_dir):
    return _round_doubles(crosstab.group_means(_gappy(spark, sf_dir), "segment", ["monthly_bill_aed"]))


def q_gaps_outliers(spark, sf_dir):
    return _round_doubles(distribution.box_outliers(_gappy(spark, sf_dir), "monthly_bill_aed", "segment"))


def q_gaps_summary(spark, sf_dir):
    return _round_doubles(profile.summary(_gappy(spark, sf_dir), ["constant", "monthly_bill_aed"]))


def q_gaps_quadrants(spark, sf_dir):
    q = profile.quadrants(_gappy(spark, sf_dir))
    return q.groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"))


def q_gaps_leads(spark, sf_dir):
    return leads.lead_table(_gappy(spark, sf_dir), [None]).select("lead_rank", "respondent_id")


def q_quantiles_selected(spark, sf_dir):
    """The quantile path of large groups: at most 50 values are ranked in a task."""
    q = quantiles(raw(spark, sf_dir), ["monthly_bill_aed", "wtp_aed_per_building"], [0.25, 0.5, 0.85], ["segment"],
                  finish_limit=50, buckets=64)
    return _round_doubles(q)


# ---------------------------------------------------------------- the calculator
def q_calculator_fixed_acceptance(spark, sf_dir):
    """Each segment's respondents in place of the buildings slider, at the
    calculator's own acceptance, conversion 40 % and a fee of 7,000."""
    sizes = raw(spark, sf_dir).where("segment is not null").groupBy("segment").agg(F.count(F.lit(1)).alias("population"))
    pilots = L.truncate_to_long(F.col("population") * F.lit(CALCULATOR_ACCEPTANCE))
    paid = L.truncate_to_long(F.col("pilots") * F.lit(40) / F.lit(100.0))
    return sizes.withColumn("pilots", pilots).withColumn("paid_clients", paid).select(
        "segment", "population", "pilots", "paid_clients", (F.col("paid_clients") * 7000).alias("mrr"),
        (F.col("paid_clients") * 7000 * 12).alias("arr"), L.percent_label(F.lit(CALCULATOR_ACCEPTANCE * 100)).alias("acceptance_label"))


# Fixed value: the pilot acceptance that the calculator uses.
CALCULATOR_ACCEPTANCE = 0.539


# ---------------------------------------------------------------- streaming
def q_kpi_stream(spark, sf_dir):
    """Running KPI counts after streaming the survey in file by file, one per micro-batch."""
    from canvass.streaming import kpi_stream
    folder = scratch_path(spark, "responses-stream")
    raw(spark, sf_dir).write.parquet(folder)
    out = scratch_path(spark, "kpi-stream-out")
    query = kpi_stream.start_to_table(
        kpi_stream.running_kpis(kpi_stream.response_stream(spark, folder, files_per_trigger=1)), out,
        checkpoint=scratch_path(spark, "kpi-stream-ckpt"))
    query.awaitTermination()
    return _round_doubles(kpi_stream.latest(spark, out))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_roundtrip": q_csv_roundtrip,
    "csv_reordered": q_csv_reordered,
    "csv_quarantine": q_csv_quarantine,
    "distinct_options": q_distinct_options,
    "filtered_counts": q_filtered_counts,
    "filter_null_member": q_filter_null_member,
    "optional_filter": q_optional_filter,
    "impute_median": q_impute_median,
    "feature_matrix_imputed": q_feature_matrix_imputed,
    "predicate_counts": q_predicate_counts,
    "scalar_labels": q_scalar_labels,
    "kpi_row": q_kpi_row,
    "kpi_row_all": q_kpi_row_all,
    "share_of_total": q_share_of_total,
    "bill_summary": q_bill_summary,
    "savings_estimate": q_savings_estimate,
    "prospect_quadrants": q_prospect_quadrants,
    "quadrant_counts": q_quadrant_counts,
    "crosstab_adoption": q_crosstab_adoption,
    "crosstab_model": q_crosstab_model,
    "crosstab_spike": q_crosstab_spike,
    "pain_prevalence": q_pain_prevalence,
    "tech_deployment": q_tech_deployment,
    "score_profile_scaled": q_score_profile_scaled,
    "score_profile_transposed": q_score_profile_transposed,
    "wtp_median_by_segment": q_wtp_median_by_segment,
    "hist_bill": q_hist_bill,
    "hist_share": q_hist_share,
    "hist_wtp_by_class": q_hist_wtp_by_class,
    "box_bill": q_box_bill,
    "box_wtp": q_box_wtp,
    "box_outliers": q_box_outliers,
    "lead_table": q_lead_table,
    "basket_items": q_basket_items,
    "frequent_itemsets": q_frequent_itemsets,
    "rules_all": q_rules_all,
    "rules_top20": q_rules_top20,
    "rules_summary": q_rules_summary,
    "rules_min_lift": q_rules_min_lift,
    "scenario_grid": q_scenario_grid,
    "scenario_by_segment": q_scenario_by_segment,
    "label_encode": q_label_encode,
    "class_weights": q_class_weights,
    "stratified_split": q_stratified_split,
    "random_split": q_random_split,
    "cv_folds": q_cv_folds,
    "confusion_fixed_rule": q_confusion_fixed_rule,
    "report_fixed_rule": q_report_fixed_rule,
    "macro_f1_fixed_rule": q_macro_f1_fixed_rule,
    "regression_metrics_fixed_rule": q_regression_metrics_fixed_rule,
    "actual_vs_predicted_fixed_rule": q_actual_vs_predicted_fixed_rule,
    "inertia_given_labels": q_inertia_given_labels,
    "silhouette_given_labels": q_silhouette_given_labels,
    "scaled_matrix": q_scaled_matrix,
    "kmeans_assignments": q_kmeans_assignments,
    "cluster_profile": q_cluster_profile,
    "elbow": q_elbow,
    "pca_points": q_pca_points,
    "pca_variance": q_pca_variance,
    "pca_centroids": q_pca_centroids,
    "silhouette_kmeans": q_silhouette_kmeans,
    "rf_importances": q_rf_importances,
    "rf_cv_macro_f1": q_rf_cv_macro_f1,
    "rf_confusion": q_rf_confusion,
    "rf_report": q_rf_report,
    "gbt_importances": q_gbt_importances,
    "gbt_metrics": q_gbt_metrics,
    "gbt_actual_vs_predicted": q_gbt_actual_vs_predicted,
    "kpi_stream": q_kpi_stream,
    "kmeans_facts": q_kmeans_facts,
    "elbow_facts": q_elbow_facts,
    "silhouette_euclidean": q_silhouette_euclidean,
    "silhouette_euclidean_points": q_silhouette_euclidean_points,
    "approx_quantiles_error": q_approx_quantiles_error,
    "states_kpi": q_states_kpi,
    "states_crosstab": q_states_crosstab,
    "states_group_means": q_states_group_means,
    "pca_facts": q_pca_facts,
    "rf_test_rows": q_rf_test_rows,
    "gbt_test_rows": q_gbt_test_rows,
    "importance_facts": q_importance_facts,
    "rf_scored_by_table": q_rf_scored_by_table,
    "gbt_scored_by_table": q_gbt_scored_by_table,
    "importances_by_table": q_importances_by_table,
    "residual_boost_facts": q_residual_boost_facts,
    "residual_boost_metrics": q_residual_boost_metrics,
    "gaps_impute": q_gaps_impute,
    "gaps_crosstab": q_gaps_crosstab,
    "gaps_group_means": q_gaps_group_means,
    "gaps_outliers": q_gaps_outliers,
    "gaps_summary": q_gaps_summary,
    "gaps_quadrants": q_gaps_quadrants,
    "gaps_leads": q_gaps_leads,
    "quantiles_selected": q_quantiles_selected,
    "calculator_fixed_acceptance": q_calculator_fixed_acceptance,
}

assert len(RESPONSE_COLUMNS) == 40
