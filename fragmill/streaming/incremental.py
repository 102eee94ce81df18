"""Postings and term counts kept up to date by Structured Streaming.

Each micro-batch of new symbols is posted and appended under its batch number;
a batch that is run again after a failure overwrites its own files, so every
symbol counts once.  Late symbols are no problem: postings have no order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fragmill.operators import index as I


def start(symbols: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Keeps postings of a streaming table of symbols at ``path``."""

    def append(batch: DataFrame, number: int) -> None:
        I.postings(I.declaration_terms(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = symbols.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("term", "symbol_id", "field").agg(F.sum("tf").alias("tf"))


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events of each type in each window of ``events(ts, event_type, value)``, with a watermark for what comes late."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
