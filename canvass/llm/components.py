"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each end of the links (a, b) the smallest node that
    it can reach. Each round a node takes the smallest label around it and then
    that label's own label, so long chains halve; the labels are written every
    round. Ends when no label changes."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least")))
        stepped = labels.join(around, labels["node"] == around["a"]).select(
            "node", F.least("component", "least").alias("to"), F.col("component").alias("was"))
        of = labels.select(F.col("node").alias("to"), F.col("component").alias("next"))
        moved = written(stepped.join(of, "to", "left").select(
            "node", F.coalesce(F.least("to", "next"), F.col("to")).alias("component"), "was"), "labels")
        labels = moved.select("node", "component")
        if moved.where("component <> was").isEmpty():
            return labels
