"""Missing values, names with separators, infinities and layouts: cases the fixture doesn't reach."""
import math

import pytest
from pyspark.sql import functions as F

from canvass.operators import basket, clean, cluster, crosstab, distribution, leads, profile
from canvass.operators.quantile import quantiles
from canvass.sources import io
from canvass.sources.schema import CLUSTER_FEATURES, RESPONSES_SCHEMA

NAN = float("nan")


def test_nan_is_filled_like_null(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate([1.0, 2.0, 3.0, NAN, None, 2.5, 1.5])], "respondent_id int, x double")
    for out in (clean.impute_median(df, ["x"]), clean.feature_matrix(df, ["x"])):
        assert [r.x for r in out.orderBy("respondent_id").collect()] == [1.0, 2.0, 3.0, 2.0, 2.0, 2.5, 1.5]


def test_nan_is_no_outlier_and_leaves_the_mean(spark):
    df = spark.createDataFrame([(k, "a", x) for k, x in enumerate([1.0, 2.0, 3.0, 2.0, 100.0, NAN])], "respondent_id int, g string, x double")
    assert [(r.respondent_id, r.side) for r in distribution.box_outliers(df, "x", "g").collect()] == [(4, "high")]
    assert crosstab.group_means(df, "g", ["x"]).first().rate == pytest.approx(21.6)


def test_constant_column_has_no_skew(spark):
    df = spark.createDataFrame([(2.0,)] * 4, "x double")
    assert profile.summary(df, ["x"]).first().skew == 0.0
    assert profile.summary(df.limit(2), ["x"]).first().skew is None


def test_absent_pairs_are_zero_cells(spark):
    df = spark.createDataFrame([("a", "u"), ("a", "v"), ("b", "u"), (None, "w")], "r string, c string")
    got = {(r.r, r.c): (r.n, r.pct) for r in crosstab.crosstab(df, "r", "c").collect()}
    assert got == {("a", "u"): (1, 50.0), ("a", "v"): (1, 50.0), ("b", "u"): (1, 100.0), ("b", "v"): (0, 0.0)}


def test_missing_values_have_no_quadrant(spark):
    rows = [(1, "s", 1.0, 1.0), (2, "s", 9.0, 9.0), (3, "s", None, 9.0), (4, "s", 9.0, NAN)]
    df = spark.createDataFrame(rows, "respondent_id int, segment string, monthly_bill_aed double, wtp_aed_per_building double")
    got = {r.respondent_id: r.quadrant for r in profile.quadrants(df).collect()}
    assert got[3] is None and got[4] is None and got[1] is not None


def test_a_null_class_can_be_chosen(spark, responses_small):
    df = responses_small.withColumn("adoption_class", F.when(F.col("respondent_id") % 2 == 0, F.col("adoption_class")))
    assert leads.lead_table(df, [None], n=10).where("adoption_class is null").count() == 10


def test_csv_tokens_are_missing(spark, tmp_path):
    names = [f.name for f in RESPONSES_SCHEMA]
    path = tmp_path / "survey.csv"
    lines = [",".join(names)]
    for k, token in enumerate(["NA", "nan", "null", "NaN", "N/A", ""]):
        lines.append(",".join(str(k) if n == "respondent_id" else token for n in names))
    path.write_text("\n".join(lines) + "\n")
    got = io.read_responses(spark, str(path), fmt="csv")
    assert got.count() == 6 and all(got.where(F.col(n).isNotNull()).count() == 0 for n in names if n != "respondent_id")


def test_rules_of_items_that_hold_the_separator(spark):
    items = [["a", "b"], ["a", "b", "c"], ["a, b", "c"], ["a", "a, b", "c"], ["a", "b", "a, b", "c"]] * 3
    baskets = spark.createDataFrame(list(enumerate(items)), "respondent_id int, items array<string>")
    sets = basket.frequent_itemsets(baskets, 0.2)
    rules = basket.association_rules(sets, 0.0)
    splits = sum(2 ** r["size"] - 2 for r in sets.collect())
    assert rules.count() == splits == rules.select("antecedent_items", "consequent_items").distinct().count()


def test_rules_of_many_items(spark):
    names = [f"i{k:02d}" for k in range(40)]
    sets = spark.createDataFrame([(names, 40, 1.0)], "items array<string>, size int, support double")
    top = sets.selectExpr("shiftleft(1L, size) - 2L as last").first().last
    assert top == 2**40 - 2  # the masks of an itemset go beyond 32 bits


def test_infinities_end_in_a_few_passes(spark):
    values = [-math.inf, math.inf] + [float(k) for k in range(49)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = {r.p: r.value for r in quantiles(df, ["x"], [0.0, 0.5, 0.98, 1.0], finish_limit=10, buckets=8).collect()}
    assert got == {0.0: -math.inf, 0.5: 24.0, 0.98: 48.0, 1.0: math.inf}


def test_wide_ranges_do_not_overflow(spark):
    values = [-1.7e308, 1.7e308] + [1e-300 * k for k in range(40)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = quantiles(df, ["x"], [0.5], finish_limit=5, buckets=64).first().value
    assert got == pytest.approx((1e-300 * 19 + 1e-300 * 20) / 2, rel=1e-9)


def test_kmeans_does_not_depend_on_the_input_layout(spark, responses_small):
    vec = cluster.with_vector(cluster.scaled_matrix(responses_small), CLUSTER_FEATURES)
    fits = [cluster.kmeans_best(v, 4, seeds=[42]) for v in (vec.coalesce(1), vec.repartition(7, "pain_high_cost"))]
    assert fits[0].cost == pytest.approx(fits[1].cost, rel=1e-6)
    sizes = [sorted(r["count"] for r in cluster.assign(f, vec).groupBy("cluster").count().collect()) for f in fits]
    assert sizes[0] == sizes[1]
    assert cluster._fit_input(vec).rdd.getNumPartitions() == cluster.FIT_PARTITIONS


def test_queries_without_imputed_columns_start_no_job(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL

    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("before-the-action", "building a query")
    df = E.queries()["crosstab_adoption"](spark, SF_SMALL)
    started = status.getJobIdsForGroup("before-the-action")
    spark.sparkContext.setJobGroup("other", "")
    # reading a Parquet table's schema is a job of its own for each of the six tables
    assert len(started) <= 6
    assert df.count() > 0


def test_nothing_stays_cached(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL

    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("kpi_row", "box_bill", "rules_all", "report_fixed_rule", "hist_bill", "stratified_split"):
        E.queries()[name](spark, SF_SMALL).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
