"""Token counts: an exact histogram of encoded lengths whose running and suffix
sums answer totals, quantiles and truncated totals for every context limit.

A text is encoded once, in Arrow batches on the executors; from then on only
(length, documents) rows move. The sums over lengths run in two levels (blocks
of lengths, then inside each block), so no task takes the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ENCODE_BYTES, Encoder, vocabulary
from .common import chunks, written

#: Lengths per block of the two-level sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(length) per document: its number of tokens, as ``bpe.encode`` makes them
    (a special token's string in a text is one token); 0 for null or empty texts,
    any length of text. ``path`` is a byte-level tokenizer file, at the same path on every executor."""
    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for batch in chunks(batches, "text", ENCODE_BYTES):
            _, offsets = encoder.encode(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(offsets[1:] - offsets[:-1], pa.int64())], ["length"])

    return docs.select(F.col(text).alias("text")).mapInArrow(lengths, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, and one for length 0.

    n_docs and n_tokens of exactly that length; docs_up_to and tokens_up_to sum
    the lengths up to it, docs_longer and tokens_longer those beyond it;
    truncated_total is the number of tokens if every document is cut at it;
    share is docs_up_to over all documents (null for an empty table);
    next_length is the next length that occurs (null at the last)."""
    spark = lengths.sparkSession
    found = written(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")
    counts = (found
              .unionByName(spark.range(1).select(F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("n_docs")))
              .groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
              .withColumn("n_tokens", F.col("length") * F.col("n_docs"))
              .withColumn("block", F.floor(F.col("length") / BLOCK)))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"), F.min("length").alias("first"))
    up, all_ = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(up), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(up), F.lit(0)).alias("t0"),
        F.sum("d").over(all_).alias("docs"), F.sum("t").over(all_).alias("tokens"),
        F.lead("first").over(Window.orderBy("block")).alias("next_first"))
    inside = Window.partitionBy("block").orderBy("length")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (counts.join(blocks, "block")
            .withColumn("docs_up_to", F.col("d0") + F.sum("n_docs").over(running))
            .withColumn("tokens_up_to", F.col("t0") + F.sum("n_tokens").over(running))
            .withColumn("next_length", F.coalesce(F.lead("length").over(inside), F.col("next_first")))
            .select("length", "n_docs", "n_tokens", "docs_up_to", "tokens_up_to",
                    (F.col("docs") - F.col("docs_up_to")).alias("docs_longer"),
                    (F.col("tokens") - F.col("tokens_up_to")).alias("tokens_longer"),
                    (F.col("tokens_up_to") + F.col("length") * (F.col("docs") - F.col("docs_up_to"))).alias("truncated_total"),
                    F.when(F.col("docs") > 0, F.col("docs_up_to") / F.col("docs")).alias("share"), "next_length"))


def truncated(hist: DataFrame, limit: int) -> DataFrame:
    """(n_docs_cut, total) for any context limit, also one that no document has:
    between two lengths that occur, the total grows by docs_longer a token."""
    at = hist.where((F.col("length") <= limit) & ((F.col("next_length") > limit) | F.col("next_length").isNull()))
    return at.select(F.col("docs_longer").alias("n_docs_cut"), (F.col("tokens_up_to") + F.lit(limit) * F.col("docs_longer")).alias("total"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """(length): the smallest length that at least the share ``q`` of documents doesn't exceed."""
    return hist.where(F.col("share") >= q).agg(F.min("length").alias("length"))
