"""Connected components by alternating large-star and small-star rounds (Kiveris and others, 2014).

A set of at most ``ONE_TASK`` edges, counted first, is joined up in one task
of an executor instead; rounds of small exchanges would cost more than they do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.runtime import cut

#: Most edges of one task: about 100 MB there.
ONE_TASK = 200_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := low.setdefault(x, x)) != x:
            low[x] = low[up] = low.setdefault(low[up], low[up])
            x = low[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            low[max(a, b)] = min(a, b)
    ids = list(low)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["id", "comp"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours move to the smallest id of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Cut, so that Spark can split a hub's edges over tasks where they meet it.
    low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
    joined = both.join(low, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and comp (the smallest id reachable) for each node of ``nodes(id)`` under ``edges(a, b)``.

    Null ends and loops are ignored.  Each round is cut; rounds grow with the
    logarithm of a component's size.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= ONE_TASK:
        found = now.repartition(1).mapInArrow(_union_find, "id long, comp long")
        return nodes.join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    seen = None
    while True:
        now = cut(_stars(_stars(now, large=True), large=False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first()
        if state == seen:
            break
        seen = state
    return nodes.join(now.select(F.col("a").alias("id"), F.col("b").alias("comp")), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
