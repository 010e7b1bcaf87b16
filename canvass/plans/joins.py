"""Join helpers: derived tables are written to the shared folder, so that Spark
knows their size in bytes and broadcasts them only below its own threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame

from canvass.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage,
    holds no cache, and its size is known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join ``big`` to a derived side that is small as a rule (group statistics,
    brackets, supports). It is broadcast if its files are below
    ``spark.sql.autoBroadcastJoinThreshold``, else the join shuffles."""
    return big.join(stored(small, "small"), on, how)
