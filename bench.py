"""Benchmark: headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR.

Loads the survey table once (fixture joins + load-time medians) and writes it
to the checkpoint folder (a temporary one on a single machine), then times each headline query end to end
(driver-side decisions plus a full ``noop`` write of the result). Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "kpi_row", "share_of_total", "bill_summary", "savings_estimate", "crosstab_adoption",
    "crosstab_spike", "pain_prevalence", "score_profile_scaled", "wtp_median_by_segment",
    "hist_bill", "hist_wtp_by_class", "box_bill", "box_outliers", "prospect_quadrants", "lead_table",
    "frequent_itemsets", "rules_top20", "scenario_by_segment", "stratified_split", "scaled_matrix",
    "silhouette_given_labels", "kmeans_assignments",
    "elbow", "pca_variance", "silhouette_kmeans", "cluster_profile", "rf_cv_macro_f1", "rf_report", "gbt_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("canvass-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(max(8, cpus * 2)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from canvass.plans import catalog
    from canvass.session import checkpoint_dir

    checkpoint_dir(spark)

    timings: dict[str, float] = {}
    t = time.perf_counter()
    catalog.materialize(spark, sf_dir)
    timings["load_responses"] = round(time.perf_counter() - t, 3)
    for name in (only or HEADLINE):
        fn = catalog.QUERIES[name]
        t = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t, 3)
        print(f"# {name}: {timings[name]}s", file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
