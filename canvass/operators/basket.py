"""Basket mining: items, frequent itemsets and association rules.

Itemsets come from MLlib's parallel FP-growth. Rules are built here, because
MLlib's ``associationRules`` only emits single-item consequents: one side of a rule
grows level by level through the itemsets, the other is what remains of the
itemset, and both sides' supports come from joins to the written itemset table
(broadcast if its files are small). Every itemset's subsets are frequent too, so
the joins always find a partner.

Metrics: support s = freq/n of the union, confidence = s / s(A),
lift = s / (s(A) * s(C)) (symmetric in A and C by construction, so A=>C and
C=>A tie exactly), leverage = s - s(A) * s(C).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.labels import item_name, round_half_even
from canvass.operators.leads import top_n
from canvass.plans.joins import stored
from canvass.sources.schema import BASKET_COLS

ITEM_SEP = ", "


def basket(df: DataFrame, cols: Sequence[str] = BASKET_COLS, id_col: str = "respondent_id") -> DataFrame:
    """B1: ``(id, items)`` with the names of the flags that are set (missing = absent)."""
    present = [F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.lit(item_name(c))) for c in cols]
    items = F.filter(F.array(*present), lambda x: x.isNotNull())
    return df.select(id_col, F.array_sort(items).alias("items"))


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.15,
                      num_partitions: int | None = None) -> DataFrame:
    """B2: ``(items, itemset, size, freq, support)`` with support >= ``min_support``.

    ``support`` divides by every basket, empty ones included.
    """
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    model = fp.fit(baskets)
    total = baskets.select(F.count(F.lit(1))).scalar()
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    return sets.select("items", F.array_join("items", ITEM_SEP).alias("itemset"),
                       F.size("items").alias("size"), "freq",
                       (F.col("freq") / total).alias("support"))


def rule_sides(itemsets: DataFrame) -> DataFrame:
    """(items, support, side, side_support): each itemset with each of its subsets
    of at most half its size that is an itemset too.

    Subsets grow by one item a level, in the items' order, and a level keeps those
    that the join with the itemsets finds, so no subset is laid out that isn't
    frequent, and no row holds more than one of them."""
    sides = stored(itemsets.select("items", "support"), "supports")
    named = sides.select(F.col("items").alias("side"), F.col("support").alias("side_support"))
    grown = sides.where(F.size("items") >= 2).select("items", "support", F.explode("items").alias("item")).select(
        "items", "support", F.array("item").alias("side"))
    found, level = None, 1
    while True:
        here = stored(grown.join(named, "side"), "rule-sides")
        found = here if found is None else found.unionByName(here)
        level += 1
        longer = here.where(F.size("items") >= 2 * level)
        if longer.isEmpty():
            return found
        later = F.filter("items", lambda x: x > F.element_at("side", -1))
        grown = longer.select("items", "support", "side", F.explode(later).alias("item")).select(
            "items", "support", F.concat("side", F.array("item")).alias("side"))


def association_rules(itemsets: DataFrame, min_lift: float = 1.2) -> DataFrame:
    """Every rule A => C with A, C non-empty, disjoint and A u C frequent, lift >= ``min_lift``.

    The sides are sorted item arrays (``antecedent_items``, ``consequent_items``);
    ``antecedents`` and ``consequents`` are their texts, for display. The smaller
    sides come from :func:`rule_sides`, the others are what remains of the itemset, and
    each such pair is a rule in both directions. An itemset may have any number
    of items; rules whose sides aren't in ``itemsets`` are left out.
    """
    rest = F.array_except("items", "side")
    other = itemsets.select(F.col("items").alias("rest"), F.col("support").alias("rest_support"))
    both = rule_sides(itemsets).withColumn("rest", rest).join(other, "rest")
    one = both.select(F.col("side").alias("antecedent_items"), F.col("rest").alias("consequent_items"),
                      F.col("side_support").alias("antecedent_support"), F.col("rest_support").alias("consequent_support"), "support")
    # of halves, each is a side of its own
    two = both.where(F.size("side") * 2 < F.size("items")).select(
        F.col("rest").alias("antecedent_items"), F.col("side").alias("consequent_items"),
        F.col("rest_support").alias("antecedent_support"), F.col("side_support").alias("consequent_support"), "support")
    sa, sc, s = F.col("antecedent_support"), F.col("consequent_support"), F.col("support")
    return one.unionByName(two).select(
        "antecedent_items", "consequent_items",
        F.array_join("antecedent_items", ITEM_SEP).alias("antecedents"),
        F.array_join("consequent_items", ITEM_SEP).alias("consequents"), "antecedent_support", "consequent_support", "support",
        (s / sa).alias("confidence"), (s / (sa * sc)).alias("lift"),
        (s - sa * sc).alias("leverage"),
    ).where(F.col("lift") >= min_lift)


def rule_order():
    return [F.col("lift").desc(), F.col("confidence").desc(), F.col("antecedents").asc(),
            F.col("consequents").asc(), F.col("antecedent_items").asc(), F.col("consequent_items").asc()]


def top_rules(rules: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` rules of highest lift (ties: confidence, then the sides' text)."""
    return top_n(rules, rule_order(), n, "rule_rank")


def rules_summary(rules: DataFrame, scope: str) -> DataFrame:
    """Number of rules, max lift and max confidence."""
    return rules.agg(F.count(F.lit(1)).alias("n_rules"), F.max("lift").alias("max_lift"),
                     F.max("confidence").alias("max_confidence")).withColumn("scope", F.lit(scope))


def rules_table(rules: DataFrame, min_lift: float = 1.2, decimals: int = 3) -> DataFrame:
    """Rules with lift >= ``min_lift``; metrics rounded half-even for display."""
    return rules.where(F.col("lift") >= min_lift).select(
        "antecedents", "consequents",
        round_half_even("support", decimals).alias("support"),
        round_half_even("confidence", decimals).alias("confidence"),
        round_half_even("lift", decimals).alias("lift"))
