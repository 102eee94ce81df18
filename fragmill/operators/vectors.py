"""Word vectors for grounding: a vocabulary within a memory budget, initial vectors by a ladder, training, expansion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.operators.grounding import cosine_top, top_targets

# Bytes of a row's three copies of a float with overhead, and the ceilings of two vector sets.
ROW_BYTES, OVERHEAD = 4 * 3, 1.35
BASE_CEILING, ADAPTED_CEILING, LEAST = 0.60, 0.65, 0.05


def vocabulary_plan(terms: DataFrame, protected: DataFrame, dim: int, budget_mb: float) -> DataFrame:
    """term and df of ``terms(term, df)`` that fit the budget: protected ones first, then by falling df, then by name.

    The cut is the df and name of the last row that fits, found by top-k.
    """
    fits = max(int(budget_mb * 1e6 // (dim * ROW_BYTES * OVERHEAD)), 0)
    kept = terms.join(protected.select("term").distinct(), "term", "left_semi").count()
    if kept > fits:
        raise ValueError(f"{kept} protected terms need more than the budget, which holds {fits}")
    marked = terms.join(protected.select("term", F.lit(0).alias("__p")).distinct(), "term", "left").withColumn("__p", F.coalesce("__p", F.lit(1)))
    return marked.orderBy("__p", F.desc("df"), "term").limit(fits).drop("__p")


def seeded_normal(term: str, dim: int) -> list[float]:
    """The same vector of length 1 for a term everywhere, from a digest of it."""
    seed = int.from_bytes(hashlib.sha256(term.encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).normal(0, 1, dim)
    return (v / np.linalg.norm(v)).tolist()


def initial_vectors(terms: DataFrame, known: DataFrame, pieces: DataFrame, dim: int) -> DataFrame:
    """term, v and origin: the known vector of the term, or of its lower case, or the mean of its pieces', or a seeded one.

    ``known(term, v)``, ``pieces(term, pieces)``.
    """
    exact = terms.select("term").join(known.select("term", F.col("v").alias("exact")), "term", "left")
    lower = known.select(F.col("term").alias("low"), F.col("v").alias("canonical"))
    rows = exact.join(lower, F.lower("term") == F.col("low"), "left").drop("low")
    parts = pieces.select("term", F.explode("pieces").alias("piece")).join(known.select(F.col("term").alias("piece"), "v"), "piece")
    means = parts.select("term", F.posexplode("v").alias("i", "x")).groupBy("term", "i").agg(F.avg("x").alias("m")).groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("components"))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [seeded_normal(t or "", dim) for t in batch.column("term").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(made, pa.list_(pa.float64())), batch.column("origin")], names=["term", "v", "origin"])

    rows = rows.join(means, "term", "left")
    origin = F.when(F.col("exact").isNotNull(), "exact").when(F.col("canonical").isNotNull(), "canonical").when(F.col("components").isNotNull(), "components").otherwise("seeded")
    found = rows.select("term", F.coalesce(F.col("exact").cast("array<double>"), F.col("canonical").cast("array<double>"), "components").alias("v"), origin.alias("origin"))
    # Only what no rung of the ladder reached goes to a Python worker.
    return found.where("v IS NOT NULL").unionByName(found.where("v IS NULL").select("term", "origin").mapInArrow(seeded, "term string, v array<double>, origin string"))


def train(sentences: DataFrame, dim: int = 100, window: int = 5, least: int = 2, seed: int = 1) -> DataFrame:
    """term and v by skip-gram over ``sentences(words)``."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=least, seed=seed, inputCol="words", outputCol="v").fit(sentences)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("v"))


def expansion(base: DataFrame, adapted: DataFrame, k: int = 4) -> DataFrame:
    """key, target, score, reason and ord from two vector sets (term, v): the higher of their scaled cosines, itself left out."""

    def near(vectors: DataFrame, ceiling: float, reason: str) -> DataFrame:
        numbered = vectors.withColumn("id", F.xxhash64("term"))
        found = cosine_top(numbered.select("id", "v"), numbered.select("id", "v"), k + 1)
        names = numbered.select("id", "term")
        named = found.join(names.toDF("id", "key"), "id").join(names.toDF("target_id", "target"), "target_id").where("key <> target")
        score = F.round(ceiling * F.greatest(F.least((F.col("cosine") - 0.55) / 0.45, F.lit(1.0)), F.lit(0.0)), 4)
        return named.select("key", "target", score.alias("score"), F.lit(reason).alias("reason"))

    both = near(base, BASE_CEILING, "base").unionByName(near(adapted, ADAPTED_CEILING, "adapted")).where(F.col("score") >= LEAST)
    best = both.withColumn("__n", F.row_number().over(Window.partitionBy("key", "target").orderBy(F.desc("score"), "reason"))).where("__n = 1").drop("__n")
    return top_targets(best, k)
