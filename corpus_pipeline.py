"""Training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; ``run`` writes every stage's result as Parquet in the shared
folder and reads it back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import bpe, decontaminate, near_dedup, suffix_dedup, toxicity
from canvass.llm.common import written

#: Five-word shingle sets at least this much alike are near-duplicates.
NEAR_PERCENT = 80


#: The columns that stages read; all others of ``documents`` are carried along unseen.
READ = ("doc_id", "text", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but those that stages read in one struct, so that
    none is taken for an operator's own column of that name."""
    others = [c for c in docs.columns if c not in READ]
    aside = F.struct(*others) if others else F.struct(F.lit(None).alias("none"))
    return docs.select(*[c for c in docs.columns if c in READ], aside.alias("_aside"))


def _together(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return done.select(*[c if c in READ else F.col("_aside").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain, fitted on the labelled ones of
    them, doesn't call toxic. Null and empty texts stay, and so does everything
    where no document is labelled; copies share their text's verdict."""
    docs_ = _apart(docs)
    models = toxicity.fit(docs_, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _together(toxicity.predict(docs_, models).where(~F.col("is_toxic")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest
    doc_id. Null, empty and blank texts and rows without a doc_id stay; rows that
    share a doc_id stay or go together."""
    return _together(near_dedup.deduplicate(_apart(docs), NEAR_PERCENT), docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated 100-byte strings, in whole
    characters; n_chars follows the text. Null texts stay null; rows without a
    doc_id stay as they are."""
    done = suffix_dedup.remove_repeats(_apart(docs), characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    done = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _together(done, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have no window of a benchmark item; those without a word stay."""
    return _together(decontaminate.clean(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids, n_tokens and decoded: the ids of their tokens,
    their number, and the text that the ids decode to (null and empty texts: no
    ids, 0 and ''). Where ``docs`` has a column of such a name, it stays, and the new one is named ``bpe_...``."""
    done = bpe.encode(_apart(docs), public_tokenizers.path("byte_bpe_50k.json"), ids="_ids", decoded="_decoded")
    new = {"ids": F.col("_ids"), "n_tokens": F.size("_ids").cast("long"), "decoded": F.col("_decoded")}
    taken = {c.lower() for c in docs.columns}
    kept = [F.col(c) if c in READ else F.col("_aside").getField(c).alias(c) for c in docs.columns]
    return done.select(*kept, *[c.alias(f"bpe_{name}" if name in taken else name) for name, c in new.items()])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: The stages are models, connected components, string merges and merges of symbols: no SQL states them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
