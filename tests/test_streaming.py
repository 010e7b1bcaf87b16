"""Running KPIs: a restart from the checkpoint after new files arrive counts
every response exactly once."""

from pyspark.sql import functions as F

from canvass.session import scratch_path
from canvass.streaming import kpi_stream


def test_restart_counts_each_file_once(spark, responses_small):
    folder = scratch_path(spark, "stream-in")
    parts = responses_small.withColumn("_p", F.pmod(F.col("respondent_id"), F.lit(4)))
    for i in range(2):
        parts.where(F.col("_p") == i).drop("_p").write.mode("append").parquet(folder)
    ckpt, out = scratch_path(spark, "stream-ckpt"), scratch_path(spark, "stream-out")

    def run():
        q = kpi_stream.start_to_table(kpi_stream.running_kpis(
            kpi_stream.response_stream(spark, folder, files_per_trigger=1)), out, checkpoint=ckpt)
        q.awaitTermination()

    run()
    first = kpi_stream.latest(spark, out).agg(F.sum("respondents")).first()[0]
    for i in range(2, 4):
        parts.where(F.col("_p") == i).drop("_p").write.mode("append").parquet(folder)
    run()  # same checkpoint: only the new files are read, state carries over
    got = {r["segment"]: r["respondents"] for r in kpi_stream.latest(spark, out).collect()}
    want = {r["segment"]: r["count"] for r in responses_small.groupBy("segment").count().collect()}
    assert first < 1500 and got == want
