"""Shards along a Hilbert curve over document metadata.

Size, language and source are quantised to ``2**bits`` steps of near equal
row counts (size by approximate quantiles, the others by running shares in
value order, so equal values share a step).  Rows are ordered by their index
on the curve through the three steps, then by a checksum of the text and
doc_id; runs of that order are cut into shards whose counts differ by at most
one.  Neighbours on the curve are near in every dimension, so each shard
spans narrow ranges of all of them and min/max statistics prune files on any.

Ranks come from one range exchange of narrow rows: a sorted partition counts
its own rows, and only the counts of partitions meet.  The checksum and
doc_id belong to the range key, so a hot point of the curve, such as copies of
one document, spreads over partitions.

Nulls: a null size counts as 0, null language or source form a step of their
own, a null text has checksum 0.  Rows alike in all of these are
interchangeable.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.llm.runtime import cut, join_small, ranked

BITS = 8


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of points given as columns of ``axes`` (shape dimensions x points).

    Skilling's transform (2004): undo the excess work of the curve from the
    top bit down, Gray encode, then interleave the bits of all dimensions.
    """
    x = axes.astype(np.uint64).copy()
    n = len(x)
    top = np.uint64(1 << (bits - 1))
    q = top
    while q > 1:
        p = q - np.uint64(1)
        for i in range(n):
            flip = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ t)
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out


def _indexed(edges: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lang, source = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "lang_step", "source_step"))
            axes = np.stack([np.searchsorted(edges, size), lang, source])
            index = pa.array(hilbert_index(axes, bits).astype(np.int64))
            yield pa.RecordBatch.from_arrays([index if c == "curve" else x for c, x in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return run


def value_steps(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """column and step for each of its values: the share of rows before its middle, in value order."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col(column).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("n").over(order) - F.col("n") / 2
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(column, F.least(F.floor(middle / total * (1 << bits)), F.lit((1 << bits) - 1)).cast("int").alias(f"{column}_step"))


def shard(docs: DataFrame, shards: int = 24, bits: int = BITS, size: Column | None = None) -> DataFrame:
    """doc_id, h, size, text_crc32, curve, shard and slot of every row of ``docs(doc_id, text, lang, source)``.

    h (a hash of all columns) tells rows apart that share a doc_id.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8 if size is None else size
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = cut(docs.select("doc_id", F.xxhash64(*docs.columns).alias("h"), size.alias("size"), crc.alias("text_crc32"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")))
    edges = rows.agg(F.percentile_approx("size", [k / (1 << bits) for k in range(1, 1 << bits)], 10_000)).first()[0] or []
    narrow = rows
    for column in ("lang", "source"):
        narrow = join_small(narrow, cut(value_steps(rows, column, bits)), column, spread=F.col("h"))
    narrow = narrow.withColumn("curve", F.lit(None).cast("long"))
    narrow = narrow.mapInArrow(_indexed(np.array(sorted(set(edges)), np.int64), bits), narrow.schema)
    out = ranked(narrow.select("doc_id", "h", "size", "text_crc32", "curve"), ["curve", "text_crc32", "doc_id", "h"])
    total = rows.count()
    out = out.withColumn("shard", F.expr(f"CAST(rank * {shards} DIV {max(1, total)} AS INT)"))
    return out.withColumn("slot", F.expr(f"rank - (CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")).drop("rank")


def op7(docs: DataFrame) -> DataFrame:
    """Law rows: shard counts are at most one apart."""
    out = shard(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
