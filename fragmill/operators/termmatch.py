"""Terms to symbols by abbreviation: candidates of a phrase that really occur, and how they reach symbols."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.functions import text as T
from fragmill.session import share_package


def candidates(phrases: DataFrame, most: int = 5_000) -> DataFrame:
    """phrase and abbr of ``phrases(phrase)``: its possible short forms, ``most`` at the utmost."""
    share_package(phrases.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for phrase in batch.column("phrase").to_pylist():
                found = T.abbreviations(phrase or "", most)
                yield pa.RecordBatch.from_arrays([pa.array([phrase] * len(found), pa.string()), pa.array(found, pa.string())], names=["phrase", "abbr"])

    return phrases.select("phrase").distinct().mapInArrow(run, "phrase string, abbr string")


def abbreviation_pairs(phrases: DataFrame, tokens: DataFrame, longest: int = 50) -> DataFrame:
    """Phrases and those of their short forms that are tokens of the corpus and agree with them in digits and letters."""
    found = candidates(phrases.where(F.length("phrase") <= longest)).join(tokens.select(F.col("token").alias("abbr")).distinct(), "abbr", "left_semi")
    return found.where((F.col("abbr") != F.col("phrase")) & T.abbreviation_agrees(F.col("phrase"), F.col("abbr"))).select("phrase", "abbr")


def matches(terms: DataFrame, tokens: DataFrame, scores: DataFrame | None = None, gate: float = 0.4, top: int = 3) -> DataFrame:
    """term, symbol_id and via of ``terms(term)`` over ``tokens(token, symbol_id)``.

    A term reaches symbols by its words in order (all their ordered subsets) as
    they are, or by short forms of those subsets.  With ``scores(phrase, abbr,
    score)`` short forms below the gate stay only if they are among the best
    ``top`` of their phrase; the words themselves always stay.
    """
    subsets = terms.select("term", F.explode(T.ordered_subterms(F.split(F.lower("term"), r"[^a-z0-9]+"))).alias("phrase")).where("phrase <> ''")
    short = abbreviation_pairs(subsets.select("phrase"), tokens)
    if scores is not None:
        order = Window.partitionBy("phrase").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "abbr")
        short = short.join(scores, ["phrase", "abbr"], "left").withColumn("n", F.row_number().over(order)).where((F.col("score") >= gate) | (F.col("n") <= top)).select("phrase", "abbr")
    whole = subsets.select("phrase", F.replace("phrase", F.lit(" "), F.lit("")).alias("abbr")).distinct()
    ways = subsets.join(short.unionByName(whole).distinct(), "phrase").select("term", F.col("abbr").alias("token"), "phrase")
    return ways.join(tokens, "token").groupBy("term", "symbol_id").agg(F.min("token").alias("via"))


