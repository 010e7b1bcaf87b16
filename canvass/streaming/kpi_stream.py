"""Incremental KPI rows over arriving survey files (Structured Streaming).

The dashboard recomputes its KPI row whenever the survey file changes. As a
stream, new response files in a folder update running per-group counts,
shares and the mean HVAC share (A1, A2, A4, A8) with Spark's stateful
aggregation; the state and progress live in a checkpoint folder inside the
shared ``spark.checkpoint.dir``, so a restarted or recovered query resumes
exactly once. Exact medians need every value, so the streaming row carries
none; the batch :func:`canvass.operators.profile.kpi_row` has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canvass.operators.profile import share
from canvass.sources.schema import RESPONSES_SCHEMA


def response_stream(spark: SparkSession, folder: str, fmt: str = "parquet",
                    files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source of survey files with the declared schema."""
    reader = spark.readStream.schema(RESPONSES_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "csv":
        return reader.option("header", True).csv(folder)
    return reader.format(fmt).load(folder)


def running_kpis(stream: DataFrame, by: str = "segment", high_class: str = "High-Intent Buyer",
                 eval_class: str = "Evaluator", pilot_min: int = 4) -> DataFrame:
    """Per-group running counts and shares (null groups dropped)."""
    agg = stream.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("respondents"),
        F.count_if(F.col("adoption_class") == high_class).alias("n_high_intent"),
        F.count_if(F.col("adoption_class") == eval_class).alias("n_evaluator"),
        F.count_if(F.col("pilot_interest") >= pilot_min).alias("n_pilot"),
        F.sum("hvac_pct_of_bill").alias("hvac_sum"),
        F.count("hvac_pct_of_bill").alias("hvac_n"),
    )
    return agg.select(
        by, "respondents", "n_high_intent", "n_evaluator", "n_pilot",
        share(F.col("n_high_intent"), F.col("respondents")).alias("high_intent_pct"),
        share(F.col("n_evaluator"), F.col("respondents")).alias("evaluator_pct"),
        share(F.col("n_pilot"), F.col("respondents")).alias("pilot_pct"),
        F.try_divide(F.col("hvac_sum"), F.col("hvac_n")).alias("hvac_avg"))


def start_to_table(kpis: DataFrame, table_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch's full KPI table (complete mode) as parquet in a
    folder of its own, ``batch=<number>`` under ``table_path``; returns the
    running query. A batch that runs again after a crash rewrites only its own
    folder, so :func:`latest` always finds a whole table. ``checkpoint`` must be
    the same at a restart for state and progress to go on."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={epoch}")

    w = kpis.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def latest(spark: SparkSession, table_path: str) -> DataFrame:
    """The KPI table of the last batch that was written whole."""
    every = spark.read.parquet(table_path)
    return every.where(F.col("batch") == every.agg(F.max("batch")).scalar()).drop("batch")
