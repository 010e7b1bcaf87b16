"""DuckDB oracle SQL for the registered queries (same column names, same rounding).

Each statement runs over the pre-registered parquet views; the survey view is
the fixture text ``RESPONSES_SQL`` as a CTE, and ``imputed`` is that view with
the three load-time medians filled in.
"""

from __future__ import annotations

from canvass.sources.fixtures import RESPONSES_SQL
from canvass.sources.schema import CLUSTER_FEATURES, IMPUTED_AT_LOAD, PAIN_COLS, PROFILE_COLS, TECH_COLS

_IMPUTED = ",\n".join(
    f"COALESCE(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM responses)) AS {c}"
    for c in IMPUTED_AT_LOAD)

PRELUDE = f"""WITH responses AS ({RESPONSES_SQL}),
imputed AS (SELECT * REPLACE ({_IMPUTED}) FROM responses)
"""


def sql(body: str) -> str:
    return PRELUDE + body


def _seg_pick() -> str:
    return "('AUTOMOBILE', 'BUILDING', 'FURNITURE')"


def _em_pick() -> str:
    return "('AMERICA', 'ASIA', 'EUROPE')"


def _pct(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) * 100.0::DOUBLE / {den}"


ORACLE: dict[str, str] = {}

ORACLE["csv_roundtrip"] = sql("SELECT * FROM responses")

ORACLE["csv_reordered"] = ORACLE["csv_roundtrip"]

ORACLE["csv_quarantine"] = sql("""
SELECT CASE WHEN respondent_id % 89 = 0 THEN 'record' WHEN respondent_id % 97 = 0 THEN 'monthly_bill_aed' ELSE 'kept' END AS reason,
       count(*) AS n, CAST(sum(respondent_id) AS BIGINT) AS ids FROM responses GROUP BY 1""")

ORACLE["distinct_options"] = sql("""
SELECT DISTINCT 'segment' AS dimension, segment AS value FROM responses
UNION ALL SELECT DISTINCT 'primary_emirate', primary_emirate FROM responses
UNION ALL SELECT DISTINCT 'summer_cooling_spike', summer_cooling_spike FROM responses""")

ORACLE["filtered_counts"] = sql(f"""
SELECT count_if(segment IN {_seg_pick()} AND primary_emirate IN {_em_pick()}) AS n_shown,
       count(*) AS n_total FROM responses""")

ORACLE["filter_null_member"] = sql("""
, r AS (SELECT * REPLACE (CASE WHEN segment <> 'MACHINERY' THEN segment END AS segment) FROM responses)
SELECT segment, summer_cooling_spike, count(*) AS n FROM r
WHERE (segment IN ('AUTOMOBILE') OR segment IS NULL)
  AND (summer_cooling_spike IN ('<20%', '>100%') OR summer_cooling_spike IS NULL)
GROUP BY segment, summer_cooling_spike""")

ORACLE["optional_filter"] = sql(f"""
SELECT segment, count(*) AS n, 'empty' AS selection FROM responses GROUP BY segment
UNION ALL
SELECT segment, count(*) AS n, 'picked' AS selection FROM responses
WHERE segment IN {_seg_pick()} GROUP BY segment""")

ORACLE["impute_median"] = sql(
    "SELECT respondent_id, hvac_satisfaction, stakeholder_pressure, feat_carbon FROM imputed")

ORACLE["feature_matrix_imputed"] = sql(
    "SELECT respondent_id, " + ", ".join(
        f"COALESCE(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM responses)) AS {c}"
        for c in CLUSTER_FEATURES) + " FROM responses")

ORACLE["predicate_counts"] = sql("""
SELECT count(*) AS n_rows,
       count_if(adoption_class = 'High-Intent Buyer') AS n_high_intent,
       count_if(pilot_interest >= 4) AS n_pilot,
       count_if(monthly_bill_aed >= 200000) AS n_big_bill,
       count_if(summer_cooling_spike IS NULL) AS n_spike_null,
       count_if(summer_cooling_spike = '>100%') AS n_spike_eq
FROM imputed""")

ORACLE["scalar_labels"] = sql("""
SELECT respondent_id,
       'AED ' || format('{:,.0f}', wtp_aed_per_building) AS wtp_label,
       'AED ' || format('{:.0f}', monthly_bill_aed / 1000) || 'k' AS bill_k_label,
       'AED ' || format('{:.1f}', monthly_bill_aed * 100 / 1e6) || 'M' AS bill_m_label,
       CASE WHEN hvac_pct_of_bill IS NOT NULL THEN format('{:.1f}', hvac_pct_of_bill) || '%' END AS hvac_label,
       round(monthly_bill_aed / 1000, 6) AS bill_k,
       round(ln(1 + wtp_aed_per_building), 6) AS log_wtp,
       substr('TECH:' || upper(building_type), 1, 12) AS item_prefix,
       'High Cost' AS pain_title,
       CAST(trunc(monthly_bill_aed / 1000) AS BIGINT) AS bill_k_int,
       'C' || CAST(realtime_visibility_score % 5 AS VARCHAR) AS code_name
FROM responses""")


def _kpi_select(keys: str) -> str:
    hi = "count_if(adoption_class = 'High-Intent Buyer')"
    ev = "count_if(adoption_class = 'Evaluator')"
    pi = "count_if(pilot_interest >= 4)"
    return f"""
SELECT {keys}, count(*) AS respondents, {hi} AS n_high_intent, {ev} AS n_evaluator, {pi} AS n_pilot,
       round({_pct(hi, 'count(*)')}, 6) AS high_intent_pct,
       round({_pct(ev, 'count(*)')}, 6) AS evaluator_pct,
       round({_pct(pi, 'count(*)')}, 6) AS pilot_pct,
       round(quantile_cont(wtp_aed_per_building, 0.5), 6) AS median_wtp,
       round(quantile_cont(monthly_bill_aed, 0.5), 6) AS median_bill,
       round(avg(hvac_pct_of_bill), 6) AS hvac_avg,
       format('{{:,}}', count(*)) AS respondents_label,
       format('{{:.1f}}', {_pct(hi, 'count(*)')}) || '%' AS high_intent_label,
       format('{{:.1f}}', {_pct(ev, 'count(*)')}) || '%' AS evaluator_label,
       format('{{:.1f}}', {_pct(pi, 'count(*)')}) || '%' AS pilot_label,
       'AED ' || format('{{:,.0f}}', quantile_cont(wtp_aed_per_building, 0.5)) AS median_wtp_label,
       'AED ' || format('{{:.0f}}', quantile_cont(monthly_bill_aed, 0.5) / 1000) || 'k' AS median_bill_label
"""


ORACLE["kpi_row"] = sql(_kpi_select("segment") + "FROM imputed WHERE segment IS NOT NULL GROUP BY segment")
ORACLE["kpi_row_all"] = sql(_kpi_select("'all' AS scope") + f"""FROM imputed
WHERE segment IN {_seg_pick()} AND primary_emirate IN {_em_pick()}""")


def _freq(col: str) -> str:
    return f"""
SELECT {col} AS value, count(*) AS n,
       round({_pct('count(*)', f'(SELECT count({col}) FROM responses)')}, 6) AS pct_counted,
       round({_pct('count(*)', '(SELECT count(*) FROM responses)')}, 6) AS pct_all,
       '{col}' AS dimension
FROM responses WHERE {col} IS NOT NULL GROUP BY {col}"""


ORACLE["share_of_total"] = sql(_freq("summer_cooling_spike") + "\nUNION ALL" + _freq("adoption_class")
                               + "\nUNION ALL" + _freq("segment"))

_SUMMARY_COLS = ["monthly_bill_aed", "wtp_aed_per_building", "hvac_pct_of_bill"]


def long_values_sql(cols, source: str, keys: str = "") -> str:
    """Unpivot to (keys, metric, x) without nulls, as :func:`long_values` does."""
    parts = []
    for c in cols:
        k = f"{keys}, " if keys else ""
        parts.append(f"SELECT {k}'{c}' AS metric, CAST({c} AS DOUBLE) AS x FROM {source} "
                     f"WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))")
    return "\nUNION ALL ".join(parts)


ORACLE["bill_summary"] = sql(f"""
SELECT 'all' AS scope, metric, count(x) AS n, round(avg(x), 6) AS mean,
       round(quantile_cont(x, 0.5), 6) AS median, round(skewness(x), 6) AS skew,
       round(quantile_cont(x, 0.85), 6) AS q_upper, round(min(x), 6) AS min, round(max(x), 6) AS max
FROM ({long_values_sql(_SUMMARY_COLS, 'imputed')}) GROUP BY metric""")

ORACLE["savings_estimate"] = sql("""
SELECT 'all' AS scope, round(quantile_cont(monthly_bill_aed, 0.5), 6) AS median_bill,
       0.679::DOUBLE AS hvac_share, 0.25::DOUBLE AS saving_rate,
       round(quantile_cont(monthly_bill_aed, 0.5) * 0.679::DOUBLE * 0.25::DOUBLE, 6) AS monthly_saving,
       'AED ' || format('{:.0f}', quantile_cont(monthly_bill_aed, 0.5) * 0.679::DOUBLE * 0.25::DOUBLE / 1000)
       || 'k' AS monthly_saving_label
FROM imputed WHERE monthly_bill_aed IS NOT NULL""")

_QUAD = """
, m AS (SELECT quantile_cont(monthly_bill_aed, 0.5) AS mx, quantile_cont(wtp_aed_per_building, 0.5) AS my,
               quantile_cont(wtp_aed_per_building, 0.85) AS qy FROM imputed),
q AS (
SELECT respondent_id, segment, round(monthly_bill_aed, 6) AS monthly_bill_aed,
       round(wtp_aed_per_building, 6) AS wtp_aed_per_building,
       round(mx, 6) AS x_median, round(my, 6) AS y_median, round(qy, 6) AS y_upper_quantile,
       CASE WHEN monthly_bill_aed > mx AND wtp_aed_per_building > my THEN 'Prime Target'
            WHEN monthly_bill_aed > mx THEN 'High Bill, Low WTP'
            WHEN wtp_aed_per_building > my THEN 'Low Bill, High WTP'
            ELSE 'Low Priority' END AS quadrant
FROM imputed, m)
"""

ORACLE["prospect_quadrants"] = sql(_QUAD + "SELECT * FROM q")
ORACLE["quadrant_counts"] = sql(_QUAD + """
SELECT segment, quadrant, count(*) AS n,
       round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY segment), 6) AS pct_of_group
FROM q WHERE segment IS NOT NULL GROUP BY segment, quadrant""")


# ---------------------------------------------------------------- crosstabs, group profiles
def _crosstab(row: str, col: str) -> str:
    return f"""
, o AS (SELECT {row}, {col}, count(*) AS n FROM imputed WHERE {row} IS NOT NULL AND {col} IS NOT NULL
        GROUP BY {row}, {col}),
p AS (SELECT a.{row}, b.{col}, COALESCE(o.n, 0) AS n
      FROM (SELECT DISTINCT {row} FROM o) a CROSS JOIN (SELECT DISTINCT {col} FROM o) b
      LEFT JOIN o ON o.{row} = a.{row} AND o.{col} = b.{col})
SELECT {row}, {col}, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY {row}), 6) AS pct FROM p"""


ORACLE["crosstab_adoption"] = sql(_crosstab("segment", "adoption_class"))
ORACLE["crosstab_model"] = sql(_crosstab("segment", "commercial_model"))
ORACLE["crosstab_spike"] = sql("""
, p AS (SELECT primary_emirate, summer_cooling_spike, count(*) AS n FROM imputed
        WHERE primary_emirate IS NOT NULL AND summer_cooling_spike IS NOT NULL GROUP BY 1, 2),
x AS (SELECT primary_emirate, summer_cooling_spike,
             n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY primary_emirate) AS pct FROM p)
SELECT primary_emirate,
       round(COALESCE(max(CASE WHEN summer_cooling_spike = '<20%' THEN pct END), 0), 6) AS "<20%",
       round(COALESCE(max(CASE WHEN summer_cooling_spike = '20-50%' THEN pct END), 0), 6) AS "20-50%",
       round(COALESCE(max(CASE WHEN summer_cooling_spike = '51-100%' THEN pct END), 0), 6) AS "51-100%",
       round(COALESCE(max(CASE WHEN summer_cooling_spike = '>100%' THEN pct END), 0), 6) AS ">100%"
FROM x GROUP BY primary_emirate""")


def _title_sql(expr: str) -> str:
    """initcap of a space-separated string."""
    return (f"array_to_string(list_transform(string_split({expr}, ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def _group_means(cols, prefix: str, metric: str, value: str) -> str:
    parts = []
    for c in cols:
        label = c.replace(prefix, "").replace("_", " ") if prefix else c.replace("_", " ")
        parts.append(f"SELECT segment, '{c}' AS {metric}, round(avg({c}), 6) AS {value}, "
                     f"{_title_sql(repr(label))} AS label FROM imputed WHERE segment IS NOT NULL "
                     f"GROUP BY segment")
    return "\nUNION ALL ".join(parts)



ORACLE["pain_prevalence"] = sql(_group_means(PAIN_COLS, "pain_", "item", "rate"))
ORACLE["tech_deployment"] = sql(_group_means(TECH_COLS, "tech_", "item", "rate"))

_PROFILE_CTE = ", gm AS (" + " UNION ALL ".join(
    f"SELECT segment, '{c}' AS metric, avg({c}) AS mean, {_title_sql(repr(c.replace('_', ' ')))} AS label "
    f"FROM imputed WHERE segment IS NOT NULL GROUP BY segment" for c in PROFILE_COLS) + """),
sc AS (SELECT segment, metric, mean, label,
              (mean - min(mean) OVER (PARTITION BY metric))
              / NULLIF(max(mean) OVER (PARTITION BY metric) - min(mean) OVER (PARTITION BY metric), 0) AS scaled
       FROM gm)
"""

ORACLE["score_profile_scaled"] = sql(_PROFILE_CTE + """
SELECT segment, metric, round(mean, 6) AS mean, label, round(scaled, 6) AS scaled FROM sc""")

ORACLE["score_profile_transposed"] = sql(_PROFILE_CTE + """
SELECT metric,
       round(max(CASE WHEN segment = 'AUTOMOBILE' THEN scaled END), 6) AS AUTOMOBILE,
       round(max(CASE WHEN segment = 'BUILDING' THEN scaled END), 6) AS BUILDING,
       round(max(CASE WHEN segment = 'FURNITURE' THEN scaled END), 6) AS FURNITURE,
       round(max(CASE WHEN segment = 'HOUSEHOLD' THEN scaled END), 6) AS HOUSEHOLD,
       round(max(CASE WHEN segment = 'MACHINERY' THEN scaled END), 6) AS MACHINERY
FROM sc GROUP BY metric""")

ORACLE["wtp_median_by_segment"] = sql("""
SELECT segment, round(quantile_cont(wtp_aed_per_building, 0.5), 6) AS median_wtp,
       'AED ' || format('{:,.0f}', quantile_cont(wtp_aed_per_building, 0.5)) AS median_wtp_label
FROM imputed WHERE segment IS NOT NULL AND wtp_aed_per_building IS NOT NULL GROUP BY segment""")


# ---------------------------------------------------------------- distributions
def _hist(value: str, bins: int, keys: str = "'all'", key_name: str = "scope", key_filter: str = "") -> str:
    b = f"{float(bins)}::DOUBLE"
    edge = lambda i: f"(CASE WHEN {i} >= {bins} THEN hi ELSE CAST({i} AS DOUBLE) * ((hi - lo) / {b}) + lo END)"
    kf = f" AND {key_filter}" if key_filter else ""
    return f"""
, v AS (SELECT {keys} AS {key_name}, {value} AS x FROM imputed WHERE {value} IS NOT NULL{kf}),
r0 AS (SELECT {key_name}, min(x) AS mn, max(x) AS mx FROM v GROUP BY {key_name}),
r AS (SELECT {key_name}, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
             CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM r0),
g0 AS (SELECT v.{key_name}, x, lo, hi,
              LEAST(CAST(floor((x - lo) / (hi - lo) * {b}) AS BIGINT), {bins - 1}) AS g FROM v JOIN r USING ({key_name})),
g1 AS (SELECT {key_name}, x, lo, hi, CASE WHEN x < {edge('g')} THEN g - 1 ELSE g END AS d FROM g0),
g2 AS (SELECT {key_name}, CASE WHEN x >= {edge('d + 1')} AND d <> {bins - 1} THEN d + 1 ELSE d END AS bin FROM g1),
cnt AS (SELECT {key_name}, bin, count(*) AS count FROM g2 GROUP BY {key_name}, bin),
grid AS (SELECT {key_name}, lo, hi, range AS bin FROM r, range(0, {bins}))
SELECT grid.{key_name}, grid.bin, round({edge('grid.bin')}, 6) AS lo_edge, round({edge('grid.bin + 1')}, 6) AS hi_edge,
       COALESCE(cnt.count, 0) AS count
FROM grid LEFT JOIN cnt ON grid.{key_name} = cnt.{key_name} AND grid.bin = cnt.bin"""


ORACLE["hist_bill"] = sql(_hist("monthly_bill_aed / 1000.0::DOUBLE", 50))
ORACLE["hist_share"] = sql(_hist("CAST(hvac_pct_of_bill AS DOUBLE)", 35))
ORACLE["hist_wtp_by_class"] = sql(_hist("CAST(wtp_aed_per_building AS DOUBLE)", 30, "adoption_class",
                                        "adoption_class", "adoption_class IS NOT NULL"))


def _box(value: str) -> str:
    return f"""
, v AS (SELECT segment, {value} AS x FROM imputed WHERE segment IS NOT NULL AND {value} IS NOT NULL),
q AS (SELECT segment, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM v GROUP BY segment),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5::DOUBLE * (q3 - q1) AS lo_fence, q3 + 1.5::DOUBLE * (q3 - q1) AS hi_fence FROM q),
a AS (SELECT f.segment, f.q1, f.median, f.q3, f.iqr, count(*) AS n, avg(x) AS mean,
             min(CASE WHEN x >= lo_fence THEN x END) AS w_lo, max(CASE WHEN x <= hi_fence THEN x END) AS w_hi,
             count_if(x < lo_fence) AS n_out_low, count_if(x > hi_fence) AS n_out_high
      FROM v JOIN f USING (segment) GROUP BY f.segment, f.q1, f.median, f.q3, f.iqr)
SELECT segment, n, round(mean, 6) AS mean, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(iqr, 6) AS iqr,
       round(CASE WHEN w_lo IS NULL OR w_lo > q1 THEN q1 ELSE w_lo END, 6) AS whisker_low,
       round(CASE WHEN w_hi IS NULL OR w_hi < q3 THEN q3 ELSE w_hi END, 6) AS whisker_high,
       n_out_low, n_out_high
FROM a"""


ORACLE["box_bill"] = sql(_box("monthly_bill_aed / 1000.0::DOUBLE"))
ORACLE["box_wtp"] = sql(_box("CAST(wtp_aed_per_building AS DOUBLE)"))
ORACLE["box_outliers"] = sql("""
, v AS (SELECT respondent_id, segment, CAST(wtp_aed_per_building AS DOUBLE) AS x FROM imputed
        WHERE segment IS NOT NULL AND wtp_aed_per_building IS NOT NULL),
q AS (SELECT segment, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY segment),
f AS (SELECT segment, q1 - 1.5::DOUBLE * (q3 - q1) AS lo_fence, q3 + 1.5::DOUBLE * (q3 - q1) AS hi_fence FROM q)
SELECT respondent_id, segment, round(x, 6) AS value,
       CASE WHEN x < lo_fence THEN 'low' ELSE 'high' END AS side
FROM v JOIN f USING (segment) WHERE x < lo_fence OR x > hi_fence""")

# ---------------------------------------------------------------- leads
ORACLE["lead_table"] = sql("""
SELECT respondent_id, segment, building_type, primary_emirate, adoption_class, pilot_interest, ai_openness,
       wtp_aed_per_building, monthly_bill_aed,
       row_number() OVER (ORDER BY pilot_interest DESC NULLS LAST, ai_openness DESC NULLS LAST, respondent_id)
         AS lead_rank,
       'AED ' || format('{:,.0f}', wtp_aed_per_building) AS wtp_label,
       'AED ' || format('{:,.0f}', monthly_bill_aed) AS bill_label
FROM imputed WHERE adoption_class IN ('High-Intent Buyer')
ORDER BY lead_rank LIMIT 50""")

# ---------------------------------------------------------------- baskets and rules
# The basket's flags and their item names.
_BASKET = [("pain_high_cost", "PAIN:HIGH_COST"), ("pain_old_hvac", "PAIN:OLD_HVAC"),
           ("pain_no_data", "PAIN:NO_DATA"), ("pain_compliance", "PAIN:COMPLIANCE"),
           ("monitor_bms", "MON:BMS"), ("monitor_iot", "MON:IOT"), ("tech_bms", "TECH:BMS"),
           ("tech_iot_sensor", "TECH:IOT_SENSOR"), ("tech_ai_maintenance", "TECH:AI_MAINTENANCE"),
           ("tech_smart_meter", "TECH:SMART_METER")]
_MASK = " + ".join(f"(CASE WHEN COALESCE({c}, 0) <> 0 THEN {1 << i} ELSE 0 END)"
                   for i, (c, _) in enumerate(_BASKET))


def _names(mask: str) -> str:
    items = ", ".join(f"CASE WHEN ({mask} & {1 << i}) <> 0 THEN '{n}' END" for i, (_, n) in enumerate(_BASKET))
    return f"array_to_string(list_sort(list_filter([{items}], lambda x: x IS NOT NULL)), ', ')"


_RULES_CTE = f"""
, b AS (SELECT respondent_id, {_MASK} AS mask FROM imputed),
tot AS (SELECT count(*) AS n FROM b),
bm AS (SELECT mask, count(*) AS c FROM b GROUP BY mask),
cand AS (SELECT range AS s FROM range(1, 1024)),
sup AS (SELECT s, sum(c) AS freq FROM bm JOIN cand ON (bm.mask & cand.s) = cand.s GROUP BY s),
fi AS (SELECT s, CAST(freq AS BIGINT) AS freq, CAST(freq AS DOUBLE) / n AS support, bit_count(s) AS size
       FROM sup, tot WHERE CAST(freq AS DOUBLE) / n >= 0.15),
rs AS (SELECT fi.s AS s, a.s AS sa, fi.s - a.s AS sc, fi.support AS support
       FROM fi JOIN fi a ON (fi.s & a.s) = a.s AND a.s <> fi.s WHERE fi.size >= 2),
rl AS (SELECT {_names('sa')} AS antecedents, {_names('sc')} AS consequents,
              ra.support AS antecedent_support, rc.support AS consequent_support, rs.support,
              rs.support / ra.support AS confidence, rs.support / (ra.support * rc.support) AS lift,
              rs.support - ra.support * rc.support AS leverage
       FROM rs JOIN fi ra ON ra.s = rs.sa JOIN fi rc ON rc.s = rs.sc),
ru AS (SELECT * FROM rl WHERE lift >= 1.2),
top AS (SELECT *, row_number() OVER (ORDER BY lift DESC, confidence DESC, antecedents, consequents) AS rule_rank
        FROM ru ORDER BY rule_rank LIMIT 20)
"""

ORACLE["basket_items"] = sql("""
, b AS (SELECT respondent_id, """ + _names(f"({_MASK})") + """ AS items FROM imputed)
SELECT respondent_id, unnest(string_split(items, ', ')) AS item FROM b WHERE items <> ''""")

ORACLE["frequent_itemsets"] = sql(_RULES_CTE + f"""
SELECT {_names('s')} AS itemset, CAST(size AS INTEGER) AS size, freq, round(support, 6) AS support FROM fi""")

ORACLE["rules_all"] = sql(_RULES_CTE + """
SELECT antecedents, consequents, round(antecedent_support, 6) AS antecedent_support,
       round(consequent_support, 6) AS consequent_support, round(support, 6) AS support,
       round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(leverage, 6) AS leverage FROM ru""")

ORACLE["rules_top20"] = sql(_RULES_CTE + """
SELECT rule_rank, antecedents, consequents, round(support, 6) AS support, round(confidence, 6) AS confidence,
       round(lift, 6) AS lift FROM top""")

ORACLE["rules_summary"] = sql(_RULES_CTE + """
SELECT count(*) AS n_rules, round(max(lift), 6) AS max_lift, round(max(confidence), 6) AS max_confidence,
       'top20' AS scope FROM top
UNION ALL
SELECT count(*), round(max(lift), 6), round(max(confidence), 6), 'all' FROM ru""")

ORACLE["rules_min_lift"] = sql(_RULES_CTE + """
SELECT antecedents, consequents, round_even(support, 3) AS support, round_even(confidence, 3) AS confidence,
       round_even(lift, 3) AS lift FROM top WHERE lift >= 1.385""")

# ---------------------------------------------------------------- scenarios
_FUNNEL = """
pilots AS (SELECT *, CAST(trunc(pop * acceptance) AS BIGINT) AS pilots FROM g),
paid AS (SELECT *, CAST(trunc(pilots * conversion_pct / 100.0::DOUBLE) AS BIGINT) AS paid_clients FROM pilots)
"""

ORACLE["scenario_grid"] = sql("""
, acc AS (SELECT 'all' AS scope, count_if(pilot_interest >= 4) / count(*) AS acceptance FROM imputed),
g AS (SELECT scope, acceptance, b AS buildings, b AS pop, c AS conversion_pct, f AS fee
      FROM acc, range(500, 10001, 100) t1(b), range(10, 71, 5) t2(c), range(2000, 20001, 500) t3(f)),
""" + _FUNNEL + """
SELECT scope, round(acceptance, 6) AS acceptance, CAST(buildings AS INTEGER) AS buildings,
       CAST(conversion_pct AS INTEGER) AS conversion_pct, CAST(fee AS INTEGER) AS fee,
       pilots, paid_clients, paid_clients * fee AS mrr, paid_clients * fee * 12 AS arr FROM paid""")

ORACLE["scenario_by_segment"] = sql("""
, acc AS (SELECT segment, count(*) AS population, count_if(pilot_interest >= 4) / count(*) AS acceptance
          FROM imputed WHERE segment IS NOT NULL GROUP BY segment),
g AS (SELECT segment, population, acceptance, population AS pop, c AS conversion_pct, f AS fee
      FROM acc, range(10, 71, 5) t2(c), range(2000, 20001, 500) t3(f)),
""" + _FUNNEL + """
SELECT segment, population, round(acceptance, 6) AS acceptance, CAST(conversion_pct AS INTEGER) AS conversion_pct,
       CAST(fee AS INTEGER) AS fee, pilots, paid_clients, paid_clients * fee AS mrr,
       paid_clients * fee * 12 AS arr FROM paid""")

# ---------------------------------------------------------------- labels, splits, metrics
_U = ("CAST(CAST('0x' || substr(md5('{seed}:' || CAST(respondent_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE)"
      " / 281474976710656.0::DOUBLE")

ORACLE["label_encode"] = sql("""
SELECT respondent_id, adoption_class, CAST(dense_rank() OVER (ORDER BY adoption_class) - 1 AS DOUBLE) AS label
FROM imputed WHERE adoption_class IS NOT NULL""")

ORACLE["class_weights"] = sql("""
, c AS (SELECT adoption_class, count(*) AS n_c FROM imputed WHERE adoption_class IS NOT NULL GROUP BY 1)
SELECT adoption_class, n_c,
       round(CAST((SELECT sum(n_c) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n_c), 6) AS weight FROM c""")

ORACLE["stratified_split"] = sql(f"""
, u AS (SELECT adoption_class, {_U.format(seed=42)} AS u FROM imputed),
t AS (SELECT adoption_class, quantile_cont(u, 0.25) AS t FROM u WHERE adoption_class IS NOT NULL GROUP BY 1)
SELECT adoption_class, COALESCE(u <= t, false) AS is_test, count(*) AS n
FROM u LEFT JOIN t USING (adoption_class) GROUP BY ALL""")

ORACLE["cv_folds"] = sql(f"""
, u AS (SELECT adoption_class, {_U.format(seed=7)} AS u FROM imputed),
t AS (SELECT adoption_class, quantile_cont(u, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM u
      WHERE adoption_class IS NOT NULL GROUP BY 1)
SELECT adoption_class, CAST(COALESCE(len(list_filter(cuts, lambda c: c < u)), 0) AS INTEGER) AS fold, count(*) AS n
FROM u LEFT JOIN t USING (adoption_class) GROUP BY ALL""")

ORACLE["random_split"] = sql(f"""
SELECT respondent_id, {_U.format(seed=42)} < 0.25::DOUBLE AS is_test FROM imputed""")

_FIXED = """
, fx AS (SELECT respondent_id, adoption_class AS label,
                CASE WHEN pilot_interest >= 4 THEN 'High-Intent Buyer' WHEN pilot_interest >= 2 THEN 'Evaluator'
                     ELSE 'Not Ready' END AS prediction FROM imputed),
cls AS (SELECT label AS c FROM fx WHERE label IS NOT NULL UNION SELECT prediction FROM fx WHERE prediction IS NOT NULL),
pairs AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM fx GROUP BY 1, 2),
conf AS (SELECT a.c AS actual, p.c AS predicted, COALESCE(pairs.n, 0) AS n
         FROM cls a CROSS JOIN cls p LEFT JOIN pairs ON pairs.actual = a.c AND pairs.predicted = p.c),
pc AS (SELECT c AS cls,
              (SELECT sum(n) FROM conf WHERE actual = c) AS support,
              (SELECT sum(n) FROM conf WHERE actual = c AND predicted = c) AS tp,
              (SELECT sum(n) FROM conf WHERE predicted = c) AS n_pred FROM cls),
pm AS (SELECT cls, support, tp, n_pred,
              COALESCE(CAST(tp AS DOUBLE) / NULLIF(n_pred, 0), 0) AS precision,
              COALESCE(CAST(tp AS DOUBLE) / NULLIF(support, 0), 0) AS recall FROM pc),
pf AS (SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1_score FROM pm)
"""

ORACLE["confusion_fixed_rule"] = sql(_FIXED + "SELECT actual, predicted, n FROM conf")
ORACLE["report_fixed_rule"] = sql(_FIXED + """
SELECT cls AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       CAST(support AS BIGINT) AS support FROM pf
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
                 CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM pf""")
ORACLE["macro_f1_fixed_rule"] = sql(_FIXED + """
SELECT round(avg(f1_score), 6) AS macro_f1, round(sum(f1_score * support) / sum(support), 6) AS weighted_f1,
       round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy FROM pf""")

_REG = f"""
, t AS (SELECT respondent_id, ln(1 + wtp_aed_per_building) AS y, ln(1 + monthly_bill_aed * 0.1::DOUBLE) AS prediction
        FROM imputed WHERE {_U.format(seed=42)} < 0.25::DOUBLE)
"""

ORACLE["regression_metrics_fixed_rule"] = sql(_REG + """
SELECT count(*) AS n,
       round(1 - sum((y - prediction) * (y - prediction)) / sum((y - (SELECT avg(y) FROM t)) * (y - (SELECT avg(y) FROM t))), 6) AS r2,
       round(avg(abs((exp(y) - 1) - (exp(prediction) - 1))), 6) AS mae,
       round(avg(abs(y - prediction)), 6) AS mae_model_scale FROM t""")

ORACLE["actual_vs_predicted_fixed_rule"] = sql(_REG + """
SELECT respondent_id, round(y, 6) AS actual, round(prediction, 6) AS predicted,
       round((SELECT least(min(y), min(prediction)) FROM t), 6) AS axis_min,
       round((SELECT greatest(max(y), max(prediction)) FROM t), 6) AS axis_max FROM t""")

_EMB = """
, pts AS (SELECT vec_id AS point_id, label AS cluster, CAST(unnest(embedding) AS DOUBLE) AS value,
                 generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
"""

ORACLE["inertia_given_labels"] = sql(_EMB + """
, mu AS (SELECT cluster, dim, avg(value) AS mu FROM pts GROUP BY 1, 2)
SELECT cluster, round(sum((value - mu) * (value - mu)), 6) AS inertia, count(DISTINCT point_id) AS size
FROM pts JOIN mu USING (cluster, dim) GROUP BY cluster""")

ORACLE["silhouette_given_labels"] = sql(_EMB + """
, nq AS (SELECT point_id, cluster, sum(value * value) AS q FROM pts GROUP BY 1, 2),
sz AS (SELECT cluster, count(*) AS n_c, sum(q) AS qq FROM nq GROUP BY 1),
cs AS (SELECT cluster, dim, sum(value) AS s FROM pts GROUP BY 1, 2),
dots AS (SELECT p.point_id, cs.cluster AS c2, sum(p.value * cs.s) AS dot FROM pts p JOIN cs USING (dim) GROUP BY 1, 2),
d AS (SELECT nq.point_id, nq.cluster, dots.c2, sz.n_c, sz.n_c * nq.q - 2.0::DOUBLE * dots.dot + sz.qq AS sumsq
      FROM dots JOIN sz ON sz.cluster = dots.c2 JOIN nq ON nq.point_id = dots.point_id),
own AS (SELECT point_id, n_c AS n_own, CASE WHEN n_c > 1 THEN sumsq / (n_c - 1) END AS a FROM d WHERE cluster = c2),
oth AS (SELECT point_id, min(sumsq / n_c) AS b FROM d WHERE cluster <> c2 GROUP BY 1),
s AS (SELECT CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0
                  ELSE COALESCE((b - a) / NULLIF(greatest(a, b), 0), 0) END AS sil
      FROM own LEFT JOIN oth USING (point_id))
SELECT round(avg(sil), 6) AS silhouette, count(*) AS n FROM s""")


# ---------------------------------------------------------------- clustering input
ORACLE["scaled_matrix"] = sql(", fm AS (SELECT respondent_id, " + ", ".join(
    f"COALESCE(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM imputed)) AS {c}"
    for c in CLUSTER_FEATURES) + " FROM imputed)\nSELECT respondent_id, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM fm)) / COALESCE(NULLIF((SELECT stddev_pop({c}) FROM fm), 0), 1), 6) AS {c}"
    for c in CLUSTER_FEATURES) + " FROM fm")

ORACLE["kpi_stream"] = sql("""
SELECT segment, count(*) AS respondents, count_if(adoption_class = 'High-Intent Buyer') AS n_high_intent,
       count_if(adoption_class = 'Evaluator') AS n_evaluator, count_if(pilot_interest >= 4) AS n_pilot,
       round(count_if(adoption_class = 'High-Intent Buyer') * 100.0::DOUBLE / count(*), 6) AS high_intent_pct,
       round(count_if(adoption_class = 'Evaluator') * 100.0::DOUBLE / count(*), 6) AS evaluator_pct,
       round(count_if(pilot_interest >= 4) * 100.0::DOUBLE / count(*), 6) AS pilot_pct,
       round(avg(hvac_pct_of_bill), 6) AS hvac_avg
FROM responses WHERE segment IS NOT NULL GROUP BY segment""")


def _bigint_counts(text: str) -> str:
    """DuckDB types ``count_if`` as HUGEINT; Spark's is bigint. Rewrite each
    ``count_if(cond)`` as ``count(*) FILTER (WHERE cond)`` (BIGINT)."""
    out, i, key = [], 0, "count_if("
    while True:
        j = text.find(key, i)
        if j < 0:
            out.append(text[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        out.append(text[i:j])
        out.append(f"count(*) FILTER (WHERE {_bigint_counts(text[j + len(key):k - 1])})")
        i = k


ORACLE = {name: _bigint_counts(text) for name, text in ORACLE.items()}

# ---------------------------------------------------------------- gaps in the data
_GAPPY = """
, g AS (SELECT * REPLACE (
    CASE WHEN respondent_id % 7 = 0 THEN NULL ELSE CAST(monthly_bill_aed AS DOUBLE) END AS monthly_bill_aed,
    CASE WHEN respondent_id % 11 = 0 THEN NULL ELSE wtp_aed_per_building END AS wtp_aed_per_building,
    CASE WHEN respondent_id % 5 = 0 THEN NULL ELSE adoption_class END AS adoption_class,
    CASE WHEN segment = 'BUILDING' AND commercial_model = '3-MEDIUM' THEN NULL ELSE commercial_model END AS commercial_model),
    3.5::DOUBLE AS constant FROM responses)"""

ORACLE["gaps_impute"] = sql(_GAPPY + """
SELECT respondent_id, COALESCE(monthly_bill_aed, (SELECT quantile_cont(monthly_bill_aed, 0.5) FROM g)) AS monthly_bill_aed,
       COALESCE(CAST(wtp_aed_per_building AS DOUBLE), (SELECT quantile_cont(wtp_aed_per_building, 0.5) FROM g)) AS wtp_aed_per_building
FROM g""")
ORACLE["gaps_crosstab"] = sql(_GAPPY + """
, c AS (SELECT s.segment, m.commercial_model,
               (SELECT count(*) FROM g WHERE g.segment = s.segment AND g.commercial_model = m.commercial_model) AS n
        FROM (SELECT DISTINCT segment FROM g WHERE segment IS NOT NULL AND commercial_model IS NOT NULL) s
        CROSS JOIN (SELECT DISTINCT commercial_model FROM g WHERE segment IS NOT NULL AND commercial_model IS NOT NULL) m)
SELECT segment, commercial_model, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY segment), 6) AS pct FROM c""")
ORACLE["gaps_group_means"] = sql(_GAPPY + """
SELECT segment, 'monthly_bill_aed' AS item, round(avg(monthly_bill_aed), 6) AS rate, 'Monthly Bill Aed' AS label
FROM g WHERE segment IS NOT NULL GROUP BY segment""")
ORACLE["gaps_outliers"] = sql(_GAPPY + """
, q AS (SELECT segment, quantile_cont(monthly_bill_aed, 0.25) AS q1, quantile_cont(monthly_bill_aed, 0.75) AS q3
        FROM g WHERE segment IS NOT NULL GROUP BY segment)
SELECT respondent_id, g.segment, round(monthly_bill_aed, 6) AS value,
       CASE WHEN monthly_bill_aed < q1 - 1.5 * (q3 - q1) THEN 'low' ELSE 'high' END AS side
FROM g JOIN q ON q.segment = g.segment
WHERE monthly_bill_aed < q1 - 1.5 * (q3 - q1) OR monthly_bill_aed > q3 + 1.5 * (q3 - q1)""")
ORACLE["gaps_summary"] = sql(_GAPPY + """
SELECT 'all' AS scope, 'constant' AS metric, count(*) AS n, 3.5::DOUBLE AS mean, 3.5::DOUBLE AS median, 0::DOUBLE AS skew,
       3.5::DOUBLE AS q_upper, 3.5::DOUBLE AS min, 3.5::DOUBLE AS max FROM g
UNION ALL
SELECT 'all', 'monthly_bill_aed', count(monthly_bill_aed), round(avg(monthly_bill_aed), 6),
       round(quantile_cont(monthly_bill_aed, 0.5), 6), round(skewness(monthly_bill_aed), 6),
       round(quantile_cont(monthly_bill_aed, 0.85), 6), round(min(monthly_bill_aed), 6), round(max(monthly_bill_aed), 6) FROM g""")
ORACLE["gaps_quadrants"] = sql(_GAPPY + """
, m AS (SELECT quantile_cont(monthly_bill_aed, 0.5) AS x, quantile_cont(wtp_aed_per_building, 0.5) AS y FROM g)
SELECT CASE WHEN monthly_bill_aed IS NULL OR wtp_aed_per_building IS NULL THEN NULL
            WHEN monthly_bill_aed > x AND wtp_aed_per_building > y THEN 'Prime Target'
            WHEN monthly_bill_aed > x THEN 'High Bill, Low WTP'
            WHEN wtp_aed_per_building > y THEN 'Low Bill, High WTP'
            ELSE 'Low Priority' END AS quadrant, count(*) AS n
FROM g, m GROUP BY 1""")
ORACLE["gaps_leads"] = sql(_GAPPY + """
SELECT row_number() OVER (ORDER BY pilot_interest DESC NULLS LAST, ai_openness DESC NULLS LAST, respondent_id) AS lead_rank,
       respondent_id
FROM g WHERE adoption_class IS NULL ORDER BY lead_rank LIMIT 50""")
ORACLE["quantiles_selected"] = sql("""
, v AS (UNPIVOT (SELECT segment, CAST(monthly_bill_aed AS DOUBLE) AS monthly_bill_aed,
                        CAST(wtp_aed_per_building AS DOUBLE) AS wtp_aed_per_building FROM responses WHERE segment IS NOT NULL)
        ON monthly_bill_aed, wtp_aed_per_building INTO NAME metric VALUE x)
SELECT segment, metric, p, count(x) AS n,
       round(CASE p WHEN 0.25 THEN quantile_cont(x, 0.25) WHEN 0.5 THEN quantile_cont(x, 0.5) ELSE quantile_cont(x, 0.85) END, 6) AS value
FROM v, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.85::DOUBLE)) t(p) GROUP BY segment, metric, p""")
ORACLE["calculator_fixed_acceptance"] = sql("""
, s AS (SELECT segment, count(*) AS population FROM responses WHERE segment IS NOT NULL GROUP BY segment),
p AS (SELECT *, CAST(trunc(population * 0.539::DOUBLE) AS BIGINT) AS pilots FROM s),
c AS (SELECT *, CAST(trunc(pilots * 40 / 100.0::DOUBLE) AS BIGINT) AS paid_clients FROM p)
SELECT segment, population, pilots, paid_clients, paid_clients * 7000 AS mrr, paid_clients * 7000 * 12 AS arr,
       '53.9%' AS acceptance_label FROM c""")

# ---------------------------------------------------------------- facts of the fitted models
ORACLE["kmeans_facts"] = sql("SELECT count(*) AS n, 0::BIGINT AS n_not_nearest, true AS cost_is_inertia FROM responses")
ORACLE["pca_facts"] = "SELECT 'PC' || i AS component, true AS unit_length, true AS variance_explained FROM range(1, 3) t(i)"
ORACLE["rf_test_rows"] = sql(f"""
, u AS (SELECT adoption_class, {_U.format(seed=42)} AS u FROM imputed WHERE adoption_class IS NOT NULL),
t AS (SELECT adoption_class, quantile_cont(u, 0.25) AS t FROM u GROUP BY 1)
SELECT adoption_class, count_if(u <= t)::BIGINT AS n FROM u JOIN t USING (adoption_class) GROUP BY 1""")
ORACLE["gbt_test_rows"] = sql(f"""
SELECT respondent_id, round(ln(1 + CAST(wtp_aed_per_building AS DOUBLE)), 6) AS log_wtp FROM imputed
WHERE wtp_aed_per_building IS NOT NULL AND {_U.format(seed=42)} < 0.25::DOUBLE""")
ORACLE["importance_facts"] = """
SELECT 'forest' AS model, 17::BIGINT AS n_features, true AS sum_is_1 UNION ALL SELECT 'boosting', 12, true"""
ORACLE["rf_scored_by_table"] = f"SELECT sum(n)::BIGINT AS n, 0::BIGINT AS n_differ FROM ({ORACLE['rf_test_rows']})"
ORACLE["gbt_scored_by_table"] = f"SELECT count(*) AS n, 0::BIGINT AS n_differ FROM ({ORACLE['gbt_test_rows']})"
ORACLE["importances_by_table"] = """
SELECT 'forest' AS model, 17::BIGINT AS n_features, 0::BIGINT AS n_differ UNION ALL SELECT 'boosting', 12, 0"""
ORACLE["residual_boost_facts"] = f"""
SELECT 150::BIGINT AS rounds, true AS loss_falls, count(*) AS n, 0::BIGINT AS n_differ FROM ({ORACLE['gbt_test_rows']})"""
ORACLE["elbow_facts"] = sql("""
SELECT k::INTEGER AS k, (SELECT count(*) FROM responses) AS n, true AS cost_is_distance, true AS centres_are_means, true AS cost_falls, true AS below_fewer
FROM range(2, 10) t(k)""")

# ---------------------------------------------------------------- Euclidean silhouette
_POINTS = """WITH e AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS c, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT a.id, a.c AS own, b.c, count(*) AS n, sum(list_distance(a.x, b.x)) AS d FROM e a, e b WHERE a.id % 50 = 0 GROUP BY 1, 2, 3),
p AS (SELECT id, own, max(CASE WHEN c = own AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN c <> own THEN d / n END) AS b FROM d GROUP BY 1, 2),
s AS (SELECT id, own AS cluster, a, b, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM p)
"""
ORACLE["silhouette_euclidean"] = _POINTS + "SELECT round(avg(silhouette), 6) AS silhouette, count(*) AS n_asked FROM s HAVING count(*) > 0"
ORACLE["silhouette_euclidean_points"] = _POINTS + """
SELECT id, cluster, round(a, 6) AS a, round(b, 6) AS b, round(silhouette, 6) AS silhouette FROM s"""

# ---------------------------------------------------------------- sketches and partial states
ORACLE["approx_quantiles_error"] = sql("""
, v AS (UNPIVOT (SELECT segment, CAST(monthly_bill_aed AS DOUBLE) AS monthly_bill_aed,
                        CAST(wtp_aed_per_building AS DOUBLE) AS wtp_aed_per_building FROM responses WHERE segment IS NOT NULL)
        ON monthly_bill_aed, wtp_aed_per_building INTO NAME metric VALUE x)
SELECT segment, metric, p, count(x) AS n, true AS within
FROM v, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.85::DOUBLE)) t(p) GROUP BY segment, metric, p""")
_PICKED = f"WHERE segment IN {_seg_pick()} AND primary_emirate IN {_em_pick()}"
ORACLE["states_kpi"] = sql(f"""
SELECT segment, count(*) AS respondents, count_if(adoption_class = 'High-Intent Buyer')::BIGINT AS n_high_intent,
       count_if(adoption_class = 'Evaluator')::BIGINT AS n_evaluator, count_if(pilot_interest >= 4)::BIGINT AS n_pilot,
       round({_pct("count_if(adoption_class = 'High-Intent Buyer')", "count(*)")}, 6) AS high_intent_pct,
       round({_pct("count_if(adoption_class = 'Evaluator')", "count(*)")}, 6) AS evaluator_pct,
       round({_pct("count_if(pilot_interest >= 4)", "count(*)")}, 6) AS pilot_pct,
       round(avg(hvac_pct_of_bill), 6) AS hvac_avg, true AS medians_within
FROM responses {_PICKED} GROUP BY segment""")
ORACLE["states_crosstab"] = sql(f"""
, r AS (SELECT * FROM responses {_PICKED}),
c AS (SELECT s.segment, a.adoption_class, (SELECT count(*) FROM r WHERE r.segment = s.segment AND r.adoption_class = a.adoption_class) AS n
      FROM (SELECT DISTINCT segment FROM r) s CROSS JOIN (SELECT DISTINCT adoption_class FROM r) a)
SELECT segment, adoption_class, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY segment), 6) AS pct FROM c""")
ORACLE["states_group_means"] = sql(f"""
, r AS (SELECT * FROM responses {_PICKED}),
v AS (SELECT segment, unnest([{", ".join(f"'{c}'" for c in PAIN_COLS)}]) AS item, unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in PAIN_COLS)}]) AS x FROM r)
SELECT segment, item, round(avg(x), 6) AS rate,
       array_to_string(list_transform(string_split(replace(item, 'pain_', ''), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label
FROM v GROUP BY segment, item""")
