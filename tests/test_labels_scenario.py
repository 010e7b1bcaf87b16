from pyspark.sql import functions as F

from canvass.functions import labels as L
from canvass.operators import scenario


def test_labels_match_python_format(spark):
    vals = [0.5, 1.5, 2.5, 1234.5, 1234567.891, 0.125, 99.95]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select("x", L.money("x").alias("m"), L.fixed("x", 1).alias("f1"),
                    L.percent_label("x").alias("p")).collect()
    for r in got:
        assert r["m"] == f"AED {r['x']:,.0f}"
        assert r["f1"] == f"{r['x']:.1f}"
        assert r["p"] == f"{r['x']:.1f}%"
    t = spark.range(1).select(L.title_label(F.lit("pain_high_cost"), "pain_")).first()[0]
    assert t == "High Cost" == L.title_text("pain_high_cost", "pain_")
    assert L.item_name("tech_ai_maintenance") == "TECH:AI_MAINTENANCE"
    assert spark.range(1).select(L.round_half_even(F.lit(0.1245), 3)).first()[0] == 0.124


def test_funnel_known_point(spark):
    df = spark.createDataFrame([(3000, 0.539, 40, 7000)], "b int, a double, c int, f int")
    f = scenario.funnel(F.col("b"), F.col("a"), F.col("c"), F.col("f"))
    r = df.select(*[v.alias(k) for k, v in f.items()]).first()
    assert (r["pilots"], r["paid_clients"], r["mrr"], r["arr"]) == (1617, 646, 4_522_000, 54_264_000)


def test_grid_size_and_sum(spark):
    acc = spark.createDataFrame([("all", 0.539)], "scope string, acceptance double")
    g = scenario.scenario_grid(acc)
    assert g.count() == 96 * 13 * 37
    total = 0
    for b in range(500, 10001, 100):
        for c in range(10, 71, 5):
            for fee in range(2000, 20001, 500):
                total += int(int(b * 0.539) * c / 100) * fee * 12
    assert g.agg(F.sum("arr")).first()[0] == total
