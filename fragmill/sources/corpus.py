"""The sentence corpus: JSON lines that grow by appending, read again as often as needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SENTENCE = "symbol_id long, words array<string>"


def append(sentences: DataFrame, path: str) -> None:
    """Adds ``sentences(symbol_id, words)`` to the corpus at ``path``; what is there stays."""
    sentences.select("symbol_id", "words").write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SENTENCE).option("mode", "FAILFAST").json(path)


def size(spark: SparkSession, path: str) -> int:
    return read(spark, path).count()
