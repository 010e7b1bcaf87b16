"""Facts of the fixture view stated in FIXTURES.md (sf0.001)."""

from pyspark.sql import functions as F

from canvass.operators import basket, profile
from canvass.operators.leads import lead_table
from canvass.sources.schema import RESPONSE_COLUMNS


def test_shape_and_nulls(responses_small):
    assert responses_small.columns == RESPONSE_COLUMNS
    assert responses_small.count() == 1500
    assert responses_small.where(F.col("hvac_satisfaction").isNull()).count() == 27


def test_class_counts(responses_small):
    got = {r[0]: r[1] for r in responses_small.groupBy("adoption_class").count().collect()}
    assert got == {"Evaluator": 819, "High-Intent Buyer": 402, "Not Ready": 279}


def test_median_and_skew(responses_small):
    s = profile.summary(responses_small, ["wtp_aed_per_building"]).first()
    assert round(s["median"], 3) == 18100.605
    assert round(s["skew"], 4) == 1.3006


def test_lead_list_ties(responses_small):
    top = responses_small.where(F.col("adoption_class") == "High-Intent Buyer") \
        .agg(F.max("pilot_interest").alias("p")).first()["p"]
    ties = responses_small.where((F.col("adoption_class") == "High-Intent Buyer")
                                 & (F.col("pilot_interest") == top)).agg(F.max("ai_openness")).first()[0]
    n_tied = responses_small.where((F.col("adoption_class") == "High-Intent Buyer") & (F.col("pilot_interest") == top)
                                   & (F.col("ai_openness") == ties)).count()
    assert n_tied == 75
    t = lead_table(responses_small).orderBy("lead_rank").collect()
    assert len(t) == 50 and [r["lead_rank"] for r in t] == list(range(1, 51))
    ids = [r["respondent_id"] for r in t]
    assert ids == sorted(ids)  # all 50 are tied on both keys, so the id decides


def test_itemsets_and_rules(responses_small):
    sets = basket.frequent_itemsets(basket.basket(responses_small), 0.15).cache()
    assert sets.count() == 318
    rules = basket.association_rules(sets, 1.2).cache()
    assert rules.count() == 918
    single = rules.where(~F.col("consequents").contains(", ")).count()
    assert single == 71
