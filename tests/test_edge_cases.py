
import pytest
from pyspark.sql import functions as F

from canvass.functions.labels import single_line
from canvass.operators import basket, clean, crosstab, profile


def test_one_group_minmax_is_null(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 4)], "segment string, s1 int, s2 int")
    prof = crosstab.score_profile(df, "segment", ["s1", "s2"]).collect()
    assert all(r["scaled"] is None for r in prof)


def test_all_null_feature_fails_clearly(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 2.0)], "respondent_id long, a double, b double")
    with pytest.raises(ValueError, match="without any value"):
        clean.feature_matrix(df, ["a", "b"])
    filled = clean.impute_median(df, ["a", "b", "missing_col"]).collect()
    assert [r["a"] for r in filled] == [None, None]


def test_skew_needs_three_values(spark):
    df = spark.createDataFrame([(1.0,), (5.0,)], "x double")
    assert profile.summary(df, ["x"]).first()["skew"] is None
    df3 = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "x double")
    assert profile.summary(df3, ["x"]).first()["skew"] == pytest.approx(1.6523167403329906)


def test_no_rules_gives_empty_tables(spark):
    df = spark.createDataFrame([(i, 1 if i % 2 else 0, 0) for i in range(20)],
                               "respondent_id long, pain_high_cost int, tech_bms int")
    sets = basket.frequent_itemsets(basket.basket(df, ["pain_high_cost", "tech_bms"]), 0.15)
    rules = basket.association_rules(sets, 1.2)
    assert rules.count() == 0
    assert basket.rules_table(basket.top_rules(rules, 20)).count() == 0
    summ = basket.rules_summary(rules, "all").first()
    assert summ["n_rules"] == 0 and summ["max_lift"] is None


def test_single_line(spark):
    assert spark.range(1).select(single_line(F.lit("Tech-Forward\nInnovators"))).first()[0] == \
        "Tech-Forward Innovators"
