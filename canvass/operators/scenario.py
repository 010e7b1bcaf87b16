"""Revenue scenarios.

The dashboard's calculator turns three slider values into pilots, paying
clients, MRR and ARR. Here the whole slider space becomes a grid, generated
with ``sequence`` + ``explode`` from each input row (no join), and the
acceptance rate and population can come from the data (per segment).
Truncation follows Python's ``int`` (a cast to long).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.operators.profile import scoped

# Slider ranges (start, stop, step) of the calculator.
BUILDINGS = (500, 10000, 100)
CONVERSION_PCT = (10, 70, 5)
FEE_AED = (2000, 20000, 500)


def _seq(r) -> Column:
    return F.explode(F.sequence(F.lit(r[0]), F.lit(r[1]), F.lit(r[2])))


def funnel(buildings: Column, acceptance: Column, conversion_pct: Column, fee: Column) -> dict[str, Column]:
    pilots = (buildings * acceptance).cast("long")
    paid = (pilots * conversion_pct / F.lit(100.0)).cast("long")
    mrr = paid * fee.cast("long")
    return {"pilots": pilots, "paid_clients": paid, "mrr": mrr, "arr": mrr * 12}


def observed_acceptance(df: DataFrame, by=None, pilot_min: int = 4) -> DataFrame:
    """Population and share of rows with ``pilot_interest >= pilot_min`` per group."""
    data, keys = scoped(df, by)
    return data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("population"),
        (F.count_if(F.col("pilot_interest") >= pilot_min) / F.count(F.lit(1))).alias("acceptance"))


def scenario_grid(acceptance: DataFrame, buildings=BUILDINGS, conversion=CONVERSION_PCT,
                  fee=FEE_AED) -> DataFrame:
    """Every (buildings, conversion, fee) slider setting for each acceptance row."""
    keys = [c for c in acceptance.columns if c not in ("population", "acceptance")]
    g = acceptance.select(*keys, "acceptance", _seq(buildings).alias("buildings"))
    g = g.select("*", _seq(conversion).alias("conversion_pct"))
    g = g.select("*", _seq(fee).alias("fee"))
    f = funnel(F.col("buildings"), F.col("acceptance"), F.col("conversion_pct"), F.col("fee"))
    return g.select(*keys, "acceptance", "buildings", "conversion_pct", "fee",
                    *[v.alias(k) for k, v in f.items()])


def scenario_by_segment(df: DataFrame, by: str = "segment", conversion=CONVERSION_PCT,
                        fee=FEE_AED, pilot_min: int = 4) -> DataFrame:
    """Per group: population and acceptance observed in the data, over the
    conversion x fee grid."""
    acc = observed_acceptance(df, by, pilot_min)
    g = acc.select(by, "population", "acceptance", _seq(conversion).alias("conversion_pct"))
    g = g.select("*", _seq(fee).alias("fee"))
    f = funnel(F.col("population"), F.col("acceptance"), F.col("conversion_pct"), F.col("fee"))
    return g.select(by, "population", "acceptance", "conversion_pct", "fee",
                    *[v.alias(k) for k, v in f.items()])
