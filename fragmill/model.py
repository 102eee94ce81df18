"""The data model: schemas, field weights, and the handle of a lazy fragment's context."""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = "symbol_id long, name string, kind string, file string, span struct<start:int,end:int>, signature string, container string, language string, doc string, modifiers array<string>"
EDGES = "src long, dst long, kind string, site struct<start:int,end:int>, confidence double, provenance string"
POSTINGS = "term string, symbol_id long, field string, tf long"
EXPANSION = "key string, target string, score double, reason string, ord int"
HITS = "symbol_id long, unit string, satisfier int, signal string, detail string, field string, score double"
VERDICTS = "symbol_id long, source string, label string, reason string, score double"
PATHS = "nodes array<long>, kinds array<string>"

# The fields of the index and the weight of a hit in each.
FIELD_WEIGHTS: dict[str, float] = {
    "name": 1.0,
    "annotation": 0.9,
    "annotation_arg": 0.7,
    "modifier": 0.6,
    "signature": 0.6,
    "container": 0.5,
    "doc": 0.3,
}

ICF_FLOOR = 0.34
MIN_HIT_SCORE = 1e-6


def field_weight(column: Column, weights: Mapping[str, float] = FIELD_WEIGHTS) -> Column:
    """The weight of a field; a field nobody knows weighs nothing."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(known, column), F.lit(0.0))


@dataclass
class Context:
    """Everything evaluation reads: lazy tables and a few numbers.

    ``terms`` (term, df) may be given where an index holds it; otherwise it is
    derived from the postings.
    """

    symbols: DataFrame
    postings: DataFrame
    edges: DataFrame | None = None
    expansion: DataFrame | None = None
    stats: DataFrame | None = None
    weights: Mapping[str, float] = field(default_factory=lambda: dict(FIELD_WEIGHTS))
    judge: object | None = None
    icf_floor: float = ICF_FLOOR
    min_hit_score: float = MIN_HIT_SCORE
    total_override: int | None = None
    #: Number of term buckets that postings and stats are partitioned by (column bucket), if they are.
    buckets: int | None = None

    @property
    def spark(self) -> SparkSession:
        return self.symbols.sparkSession

    @cached_property
    def total(self) -> int:
        return self.symbols.count() if self.total_override is None else self.total_override

    @cached_property
    def terms(self) -> DataFrame:
        from fragmill.operators.index import with_icf

        stats = self.stats if self.stats is not None else self.postings.groupBy("term").agg(F.count_distinct("symbol_id").alias("df"))
        return with_icf(stats, self.total)

    def materialized(self) -> Context:
        """The same context over checkpointed postings and statistics, for queries that read them often."""
        from fragmill.session import cut

        posted = cut(self.postings)
        stats = self.stats if self.stats is not None else cut(posted.groupBy("term").agg(F.count_distinct("symbol_id").alias("df")))
        return replace(self, postings=posted, stats=stats, total_override=self.total)

    def about(self, table: DataFrame, terms: Sequence[str]) -> DataFrame:
        """Rows of postings or statistics for these terms; of a bucketed index only their buckets are read."""
        if self.buckets and "bucket" in table.columns:
            table = table.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in terms}) or [-1]))
        return table.where(F.col("term").isin(sorted(set(terms))))

    @cached_property
    def edge_table(self) -> DataFrame:
        return self.edges if self.edges is not None else self.spark.createDataFrame([], EDGES)
