"""Declared schema of the survey response table and the column groups the
analyses use. Never infer the schema from a file."""

from __future__ import annotations

from pyspark.sql import types as T

# Column groups named by the analyses (feature lists, flag
# groups and category orders) as the dashboard defines them.
PAIN_COLS = ["pain_high_cost", "pain_old_hvac", "pain_no_data", "pain_occupancy",
             "pain_wastage", "pain_comfort", "pain_maintenance", "pain_compliance"]
TECH_COLS = ["tech_smart_meter", "tech_iot_sensor", "tech_bms", "tech_ai_maintenance",
             "tech_solar", "tech_none"]
PROFILE_COLS = ["ai_openness", "pilot_interest", "realtime_visibility_score",
                "stakeholder_pressure", "hvac_satisfaction"]
CLUSTER_FEATURES = [
    "realtime_visibility_score", "hvac_pct_of_bill", "hvac_satisfaction",
    "stakeholder_pressure", "ai_openness", "pilot_interest",
    "feat_dashboard", "feat_auto_hvac", "feat_occupancy", "feat_predictive",
    "feat_air_quality", "feat_carbon", "feat_bms_integ", "feat_mobile_app", "feat_compliance",
    "monitor_bms", "monitor_iot", "tech_bms", "tech_iot_sensor", "tech_smart_meter",
    "tech_ai_maintenance", "pain_high_cost", "pain_compliance", "pain_no_data",
]
CLASSIFIER_FEATURES = [
    "realtime_visibility_score", "hvac_pct_of_bill", "hvac_satisfaction",
    "stakeholder_pressure", "ai_openness", "pilot_interest",
    "monitor_bms", "monitor_iot", "tech_bms", "tech_iot_sensor",
    "pain_high_cost", "pain_compliance", "pain_no_data",
    "feat_dashboard", "feat_auto_hvac", "feat_predictive", "feat_compliance",
]
REGRESSION_FEATURES = [
    "monthly_bill_aed", "hvac_pct_of_bill", "realtime_visibility_score",
    "ai_openness", "pilot_interest", "stakeholder_pressure",
    "tech_bms", "tech_iot_sensor", "tech_ai_maintenance",
    "monitor_bms", "monitor_iot", "pain_high_cost",
]
BASKET_COLS = ["pain_high_cost", "pain_old_hvac", "pain_no_data", "pain_compliance",
               "monitor_bms", "monitor_iot", "tech_bms", "tech_iot_sensor",
               "tech_ai_maintenance", "tech_smart_meter"]
LEAD_VIEW_COLS = ["respondent_id", "segment", "building_type", "primary_emirate",
                  "adoption_class", "pilot_interest", "ai_openness",
                  "wtp_aed_per_building", "monthly_bill_aed"]
IMPUTED_AT_LOAD = ["hvac_satisfaction", "stakeholder_pressure", "feat_carbon"]
# The segments of the stand-in survey.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SPIKE_ORDER = ["<20%", "20-50%", "51-100%", ">100%"]

# The survey's whole-number columns, and its fields in order.
_INT_COLS = [
    "realtime_visibility_score", "hvac_satisfaction", "stakeholder_pressure", "ai_openness",
    "pilot_interest", "feat_dashboard", "feat_auto_hvac", "feat_occupancy", "feat_predictive",
    "feat_air_quality", "feat_carbon", "feat_bms_integ", "feat_mobile_app", "feat_compliance",
    "monitor_bms", "monitor_iot", "tech_bms", "tech_iot_sensor", "tech_smart_meter",
    "tech_ai_maintenance", "tech_solar", "tech_none",
    "pain_high_cost", "pain_old_hvac", "pain_no_data", "pain_occupancy",
    "pain_wastage", "pain_comfort", "pain_maintenance", "pain_compliance",
]

RESPONSES_SCHEMA = T.StructType(
    [
        T.StructField("respondent_id", T.LongType(), False),
        T.StructField("segment", T.StringType(), True),
        T.StructField("building_type", T.StringType(), True),
        T.StructField("primary_emirate", T.StringType(), True),
        T.StructField("adoption_class", T.StringType(), True),
        T.StructField("summer_cooling_spike", T.StringType(), True),
        T.StructField("commercial_model", T.StringType(), True),
        T.StructField("monthly_bill_aed", T.DoubleType(), True),
        T.StructField("wtp_aed_per_building", T.DoubleType(), True),
        T.StructField("hvac_pct_of_bill", T.DoubleType(), True),
    ]
    + [T.StructField(c, T.IntegerType(), True) for c in _INT_COLS]
)

RESPONSE_COLUMNS = [f.name for f in RESPONSES_SCHEMA.fields]
