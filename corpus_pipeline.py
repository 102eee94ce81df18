"""A training-data pipeline over documents: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents, whatever further columns these have.  Rows
that a stage drops are gone for the next.  Repeated rows, nulls and empty texts
pass unless a stage's own rule takes them; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.llm import decontam, ftrl, hilbert, minhash, mixing
from fragmill.llm.runtime import discard, table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go; the model is fitted on labelled documents outside the held-out fold."""
    model = ftrl.fit(docs, table(spark, sf_dir, "labels"))
    return ftrl.score(docs, model, into="__toxicity").where("__toxicity < 0.5").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id: five words, similarity 0.8 or more.

    Rows that repeat a doc_id are judged one by one, each by its own text.
    """
    groups = minhash.judged(docs, 5, 80)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__key")).distinct()
    own = (F.col("doc_id").cast("long") == F.col("__doc_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    return docs.join(gone, own, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, however long they are."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights."""
    return mixing.copied(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row that is left, along the Hilbert curve."""
    return hilbert.op7(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("sharding", sharding)]

#: The stages are fitted models, sketches and random draws: no SQL; tests hold the rows that each keeps against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is written as Parquet in the shared folder, and what it read is deleted then."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir))
        if last:
            discard(spark, last)
        last = path
    return docs
