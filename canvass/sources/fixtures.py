"""Stand-in survey responses built from the supplied star-schema tables.

One row per order, shaped like the survey table (see FIXTURES.md section 3).
The DataFrame builder below and ``RESPONSES_SQL`` describe the same rows; the
SQL text is what the DuckDB oracle uses as a CTE.

Plan shape: lineitem is joined to part and aggregated per order (partial
aggregation before the shuffle on ``l_orderkey``); orders join customer on
``custkey``; the two fixed-size dimension tables (25 nations, 5 regions) are
broadcast because their parquet file size is under
``spark.sql.autoBroadcastJoinThreshold`` (a size check Catalyst makes from
file statistics), and part is broadcast only while it is small in the same
way, otherwise sort-merge joined. The per-order line summary is left-joined
on ``orderkey``, reusing the aggregation's hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.sources.schema import RESPONSE_COLUMNS, RESPONSES_SCHEMA

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _flag(cond: Column) -> Column:
    return F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``responses`` view over ``sf_dir``, with the declared schema."""
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    ptype = F.col("p_type")
    pk5 = F.col("l_partkey") % 5
    lines = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.min("l_quantity").alias("min_q"),
            F.max("l_quantity").alias("max_q"),
            F.min("l_extendedprice").alias("min_p"),
            F.max("l_discount").alias("max_d"),
            F.max("l_tax").alias("max_t"),
            _flag(ptype == "ECONOMY").alias("pain_high_cost"),
            _flag(ptype == "LARGE").alias("pain_old_hvac"),
            _flag(ptype == "MEDIUM").alias("pain_no_data"),
            _flag(ptype == "PROMO").alias("pain_compliance"),
            _flag(pk5 == 0).alias("pain_occupancy"),
            _flag(pk5 == 1).alias("pain_wastage"),
            _flag(pk5 == 2).alias("pain_comfort"),
            _flag(pk5 == 3).alias("pain_maintenance"),
            _flag(F.col("l_returnflag") == "A").alias("monitor_bms"),
            _flag(F.col("l_returnflag") == "N").alias("monitor_iot"),
            _flag(ptype == "SMALL").alias("tech_bms"),
            _flag(ptype == "STANDARD").alias("tech_iot_sensor"),
            _flag(F.col("l_returnflag") == "R").alias("tech_smart_meter"),
            _flag(F.col("l_linestatus") == "F").alias("tech_ai_maintenance"),
            _flag(F.col("l_discount") >= 0.08).alias("tech_solar"),
            _flag(pk5 == 4).alias("tech_none"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    cust = customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    base = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    joined = base.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")

    nl = F.coalesce(F.col("n_lines"), F.lit(0))
    score = nl + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    max_d = F.col("max_d")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    out = joined.select(
        ok.alias("respondent_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("building_type"),
        F.col("r_name").alias("primary_emirate"),
        F.when(score >= 6, "High-Intent Buyer").when(score >= 3, "Evaluator")
        .otherwise("Not Ready").alias("adoption_class"),
        F.when(max_d <= 0.04, "<20%").when(max_d <= 0.07, "20-50%")
        .when(max_d <= 0.09, "51-100%").when(max_d > 0.09, ">100%")
        .alias("summer_cooling_spike"),
        F.col("o_orderpriority").alias("commercial_model"),
        F.col("o_totalprice").alias("monthly_bill_aed"),
        F.coalesce(F.col("min_p"), F.lit(0.0)).alias("wtp_aed_per_building"),
        F.round(F.col("max_t") * 100, 2).alias("hvac_pct_of_bill"),
        (1 + ok % 10).cast("int").alias("realtime_visibility_score"),
        F.ceil(F.col("min_q") / 10).cast("int").alias("hvac_satisfaction"),
        F.ceil(F.col("max_q") / 10).cast("int").alias("stakeholder_pressure"),
        (1 + (nl + ck) % 5).cast("int").alias("ai_openness"),
        F.least(F.coalesce(F.col("n_lines"), F.lit(1)), F.lit(5)).cast("int").alias("pilot_interest"),
        (1 + ok % 5).cast("int").alias("feat_dashboard"),
        (1 + ck % 5).cast("int").alias("feat_auto_hvac"),
        (1 + (ok + ck) % 5).cast("int").alias("feat_occupancy"),
        (1 + (ok * 3 + ck) % 5).cast("int").alias("feat_predictive"),
        (1 + (ok % 7) % 5).cast("int").alias("feat_air_quality"),
        F.ceil(max_d * 50).cast("int").alias("feat_carbon"),
        (1 + F.least(nl, F.lit(4))).cast("int").alias("feat_bms_integ"),
        (1 + (ck % 7) % 5).cast("int").alias("feat_mobile_app"),
        (1 + (ck % 11) % 5).cast("int").alias("feat_compliance"),
        *[F.col(c).cast("int").alias(c) for c in (
            "monitor_bms", "monitor_iot", "tech_bms", "tech_iot_sensor", "tech_smart_meter",
            "tech_ai_maintenance", "tech_solar", "tech_none",
            "pain_high_cost", "pain_old_hvac", "pain_no_data", "pain_occupancy",
            "pain_wastage", "pain_comfort", "pain_maintenance", "pain_compliance")],
    )
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESPONSES_SCHEMA.fields])


def embeddings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as (point_id, cluster, dim, value): one row per coordinate."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("point_id"), F.col("label").alias("cluster"),
        F.posexplode("embedding").alias("dim", "value"),
    ).select("point_id", "cluster", "dim", F.col("value").cast("double").alias("value"))


# Fixed value: the fixture view's text, shared with the DuckDB oracle (FIXTURES.md section 3).
RESPONSES_SQL = """
WITH l AS (
  SELECT l_orderkey, COUNT(*) AS n_lines, MIN(l_quantity) AS min_q, MAX(l_quantity) AS max_q,
         MIN(l_extendedprice) AS min_p, MAX(l_discount) AS max_d, MAX(l_tax) AS max_t,
         MAX(CASE WHEN p_type = 'ECONOMY'  THEN 1 ELSE 0 END) AS pain_high_cost,
         MAX(CASE WHEN p_type = 'LARGE'    THEN 1 ELSE 0 END) AS pain_old_hvac,
         MAX(CASE WHEN p_type = 'MEDIUM'   THEN 1 ELSE 0 END) AS pain_no_data,
         MAX(CASE WHEN p_type = 'PROMO'    THEN 1 ELSE 0 END) AS pain_compliance,
         MAX(CASE WHEN l_partkey % 5 = 0   THEN 1 ELSE 0 END) AS pain_occupancy,
         MAX(CASE WHEN l_partkey % 5 = 1   THEN 1 ELSE 0 END) AS pain_wastage,
         MAX(CASE WHEN l_partkey % 5 = 2   THEN 1 ELSE 0 END) AS pain_comfort,
         MAX(CASE WHEN l_partkey % 5 = 3   THEN 1 ELSE 0 END) AS pain_maintenance,
         MAX(CASE WHEN l_returnflag = 'A'  THEN 1 ELSE 0 END) AS monitor_bms,
         MAX(CASE WHEN l_returnflag = 'N'  THEN 1 ELSE 0 END) AS monitor_iot,
         MAX(CASE WHEN p_type = 'SMALL'    THEN 1 ELSE 0 END) AS tech_bms,
         MAX(CASE WHEN p_type = 'STANDARD' THEN 1 ELSE 0 END) AS tech_iot_sensor,
         MAX(CASE WHEN l_returnflag = 'R'  THEN 1 ELSE 0 END) AS tech_smart_meter,
         MAX(CASE WHEN l_linestatus = 'F'  THEN 1 ELSE 0 END) AS tech_ai_maintenance,
         MAX(CASE WHEN l_discount >= 0.08  THEN 1 ELSE 0 END) AS tech_solar,
         MAX(CASE WHEN l_partkey % 5 = 4   THEN 1 ELSE 0 END) AS tech_none
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT o_orderkey AS respondent_id, c_mktsegment AS segment, n_name AS building_type,
       r_name AS primary_emirate,
       CASE WHEN COALESCE(n_lines, 0) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END >= 6 THEN 'High-Intent Buyer'
            WHEN COALESCE(n_lines, 0) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END >= 3 THEN 'Evaluator'
            ELSE 'Not Ready' END AS adoption_class,
       CASE WHEN max_d <= 0.04 THEN '<20%' WHEN max_d <= 0.07 THEN '20-50%'
            WHEN max_d <= 0.09 THEN '51-100%' WHEN max_d > 0.09 THEN '>100%' END AS summer_cooling_spike,
       o_orderpriority AS commercial_model,
       o_totalprice AS monthly_bill_aed,
       COALESCE(min_p, CAST(0 AS DOUBLE)) AS wtp_aed_per_building,
       ROUND(max_t * 100, 2) AS hvac_pct_of_bill,
       CAST(1 + o_orderkey % 10 AS INT) AS realtime_visibility_score,
       CAST(CEIL(min_q / 10) AS INT) AS hvac_satisfaction,
       CAST(CEIL(max_q / 10) AS INT) AS stakeholder_pressure,
       CAST(1 + (COALESCE(n_lines, 0) + o_custkey) % 5 AS INT) AS ai_openness,
       CAST(LEAST(COALESCE(n_lines, 1), 5) AS INT) AS pilot_interest,
       CAST(1 + o_orderkey % 5 AS INT) AS feat_dashboard,
       CAST(1 + o_custkey % 5 AS INT) AS feat_auto_hvac,
       CAST(1 + (o_orderkey + o_custkey) % 5 AS INT) AS feat_occupancy,
       CAST(1 + (o_orderkey * 3 + o_custkey) % 5 AS INT) AS feat_predictive,
       CAST(1 + (o_orderkey % 7) % 5 AS INT) AS feat_air_quality,
       CAST(CEIL(max_d * 50) AS INT) AS feat_carbon,
       CAST(1 + LEAST(COALESCE(n_lines, 0), 4) AS INT) AS feat_bms_integ,
       CAST(1 + (o_custkey % 7) % 5 AS INT) AS feat_mobile_app,
       CAST(1 + (o_custkey % 11) % 5 AS INT) AS feat_compliance,
       monitor_bms, monitor_iot, tech_bms, tech_iot_sensor, tech_smart_meter,
       tech_ai_maintenance, tech_solar, tech_none,
       pain_high_cost, pain_old_hvac, pain_no_data, pain_occupancy,
       pain_wastage, pain_comfort, pain_maintenance, pain_compliance
FROM orders
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
LEFT JOIN l ON l_orderkey = o_orderkey
"""

assert len(RESPONSE_COLUMNS) == 40
