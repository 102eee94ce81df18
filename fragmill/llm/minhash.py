"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of ``width`` words (ASCII lower
case, split at white space).  Its sketch has ``SIZE`` coordinates, filled in
rounds: in round r < SIZE every element draws a bin and a value r + u; in
round SIZE + j every element falls into bin j, so every coordinate is filled
after at most 2 * SIZE rounds, and the share of equal coordinates of two
sketches concentrates around their Jaccard similarity (Dahlgaard, Knudsen and
Thorup, 2017).  Bands of ``band_rows`` coordinates propose candidates, as many
as leave a pair at the threshold without a shared band in less than one case of
``MISS``: 25 bands of 5 at 0.85 (4e-7; a pair at 0.3 is proposed in 6 % of
cases), 32 bands of 4 at 0.8 (5e-8).

Links are decided on the full sets.  Documents with equal sets form one class
with a key of its own, and only its smallest id's text goes on.  No bucket's
pairs are listed: seeded stars merge most members first.  Where components
still meet in a bucket, its members outside the largest of them are compared
with all other members of the bucket, in blocks bounded by number and size, and
each pair only in the first band that it shares.  So no link between components
is lost, however large a bucket is, and buckets never chain into larger jobs.

Null and empty texts have an empty set, are linked with nothing and stay; a null
doc_id takes the component of its set.  Rows that repeat a doc_id are judged one by one, each by its own text.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.llm import bytesops as B
from fragmill.llm.components import connected_components
from fragmill.llm.runtime import cut, maybe_broadcast

SIZE, MISS = 128, 1e-6
#: Rounds of stars before the block comparison.
ROUNDS = 1
#: Members of one block of a bucket, those that are compared with them at once, and shingles of either.
BLOCK, PROBES, SHINGLES = 512, 512, 2_000_000

_rng = np.random.default_rng(20170417)
_SEEDS = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UNSET = np.iinfo(np.uint64).max


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, one after the other, and their offsets.

    A document of fewer words than ``width`` has its whole sequence as its only shingle.
    """
    words, first = B.word_hashes(data, offsets)
    counts = np.diff(first)
    h = np.zeros(max(0, len(words) - width + 1), B.U64)
    for k in range(width):
        h += words[k : k + len(h)] * _SALTS[k % 8] * B.U64(2 * k + 1)
    h = B.mix64(h)
    parts = []
    for at, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        if n >= width:
            parts.append(np.unique(h[at : at + n - width + 1]))
        elif n:
            short = np.full(1, n, B.U64)
            for w in words[at : at + n]:
                short = B.mix64(short * _SALTS[7] + w)
            parts.append(short)
        else:
            parts.append(np.zeros(0, B.U64))
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, B.U64)), np.concatenate([[0], np.cumsum(sizes)])


def sketches(elements: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> np.ndarray:
    """One row of ``size`` coordinates for each set; rows of empty sets stay unset."""
    counts = np.diff(offsets)
    out = np.full((len(counts), size), _UNSET, B.U64)
    open_ = np.flatnonzero(counts)
    shift = B.U64(64 - size.bit_length() + 1)
    for r in range(2 * size):
        if not len(open_):
            break
        if r == 0:
            x, row = elements, np.repeat(np.arange(len(counts)), counts)
        else:
            sizes = counts[open_]
            ends = np.cumsum(sizes)
            within = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
            x, row = elements[np.repeat(offsets[open_], sizes) + within], np.repeat(np.arange(len(open_)), sizes)
        x = B.mix64(x * _SEEDS[r] + _SEEDS[1023 - r])
        bins = (x >> shift).astype(np.int64) if r < size else np.full(len(x), r - size)
        value = ((x & B.U64((1 << 45) - 1)) | B.U64(r << 45)).astype(B.U64)
        fresh = np.full(len(open_) * size if r else len(counts) * size, _UNSET, B.U64)
        np.minimum.at(fresh, row * size + bins, value)
        fresh = fresh.reshape(-1, size)
        if r == 0:
            out = fresh
            open_ = np.flatnonzero(counts.astype(bool) & (out == _UNSET).any(axis=1))
        else:
            now = out[open_]
            now = np.where(now == _UNSET, fresh, now)
            out[open_] = now
            open_ = open_[(now == _UNSET).any(axis=1)]
    return out


def band_rows(percent: int, size: int = SIZE) -> int:
    """The most coordinates of a band at which a pair of this similarity shares none with a probability below ``MISS``; 1 at least."""
    return max([r for r in range(1, size + 1) if (1 - (percent / 100) ** r) ** (size // r) < MISS], default=1)


def band_hashes(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each run of ``rows`` coordinates, different from band to band."""
    bands = sketch.shape[1] // rows
    h = np.arange(1, bands + 1, dtype=B.U64)[None, :] * _SALTS[6]
    for k in range(rows):
        h = B.mix64(h + sketch[:, k::rows][:, :bands] * _SALTS[k % 6])
    return h


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64())), ("text_key", pa.int64())])


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def fingerprints(elements: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two order-free 64-bit sums over each set."""
    running = [np.concatenate([np.zeros(1, B.U64), np.cumsum(B.mix64(elements ^ s), dtype=B.U64)]) for s in _SALTS[:2]]
    return [(r[offsets[1:]] - r[offsets[:-1]]).view(np.int64) for r in running]


def signer(width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch.column("text"))
            for i, j in B.slices(offsets):
                elements, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                n = np.diff(at)
                fp = fingerprints(elements, at)
                bands = band_hashes(sketches(elements, at), rows)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands.shape[1], 0))])
                bands = bands[n > 0].ravel()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n), *map(pa.array, fp), _lists(bands, ends), batch.column("text_key").slice(i, j - i)], schema=_SIGNED)

    return run


def set_maker(width: int):
    """Sets of the texts whose fingerprints are those of the class they were joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch.column("text"))
            for i, j in B.slices(offsets):
                elements, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                fp = fingerprints(elements, at)
                own = np.logical_and.reduce([x == batch.column(c).slice(i, j - i).to_numpy() for c, x in zip(("fp1", "fp2"), fp, strict=True)])
                out = pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i), batch.column("bands").slice(i, j - i), _lists(elements, at)], names=["rep", "bands", "elements"])
                yield out.filter(pa.array(own))

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def pair_checker(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leader = None, np.zeros(0, np.int64)
        for batch in batches:
            a, b = (c.to_pylist() for c in batch.select(["a", "b"]).columns)
            sets = [batch.column(c) for c in ("a_set", "b_set")]
            keep = []
            for k, x in enumerate(a):
                if x != held:
                    held, leader = x, sets[0][k].values.to_numpy(zero_copy_only=False)
                keep.append(_linked(leader, sets[1][k].values.to_numpy(zero_copy_only=False), percent))
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[at]), pa.array(np.array(b, np.int64)[at])], names=["a", "b"])

    return run


def block_checker(percent: int):
    """Links between components inside one block of a bucket, of pairs whose first shared band is the bucket's.

    Only links that join what the block has not joined yet are given: fewer than it has components.
    """

    def links(band: int, rep: np.ndarray, comp: np.ndarray, probe: np.ndarray, bands: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        member = np.flatnonzero(~probe)
        if not len(member) or len(member) == len(rep):
            return
        sizes = np.array([len(sets[k]) for k in member])
        flat = np.concatenate([sets[k] for k in member])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for p in np.flatnonzero(probe):
            n = len(sets[p])
            open_ = comp[member] != comp[p]
            open_ &= 100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)
            open_ &= (bands[member] == bands[p]).argmax(axis=1) == band
            if not open_.any():
                continue
            at = np.searchsorted(sets[p], flat)
            hit = sets[p][np.minimum(at, n - 1)] == flat
            same = np.add.reduceat(hit.astype(np.int64), starts)
            for k in np.flatnonzero(open_ & (100 * same >= percent * (sizes + n - same))):
                if comp[member[k]] != comp[p]:
                    yield int(rep[p]), int(rep[member[k]])
                    comp[comp == comp[member[k]]] = comp[p]

    def flush(band: int, rows: list) -> pa.RecordBatch:
        rep, comp, probe, bands, sets = zip(*rows, strict=True)
        found = list(links(band, np.array(rep), np.array(comp), np.array(probe, bool), np.stack(bands), list(sets)))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket, block and part: about BLOCK + PROBES, or twice SHINGLES, of each."""
        key, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "part", "band")), strict=True))
            rep, comp, probe = (batch.column(c).to_pylist() for c in ("rep", "comp", "probe"))
            bands, sets = batch.column("bands"), batch.column("elements")
            for k, now in enumerate(keys):
                if now != key and rows:
                    yield flush(key[3], rows)
                    rows = []
                key = now
                rows.append((rep[k], comp[k], probe[k], bands[k].values.to_numpy(zero_copy_only=False), sets[k].values.to_numpy(zero_copy_only=False).view(B.U64)))
        if rows:
            yield flush(key[3], rows)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links) of every document.

    ``docs`` has doc_id and text; other columns are ignored.  Two documents are
    linked if 100 * intersection >= percent * union of their shingle sets.
    """
    return judged(docs, width, percent).drop("text_key")


def judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of ``near_duplicates`` with text_key, the xxhash64 of a row's text, which tells rows of one doc_id apart."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = cut(texts.mapInArrow(signer(width, band_rows(percent)), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<bigint>, text_key long"))
    alike = cut(signed.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("least"), F.min_by("bands", "doc_id").alias("bands")).withColumn("rep", F.xxhash64("fp1", "fp2", "n_shingles")))
    buckets = alike.select("rep", F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "bucket"))
    # What a hot bucket meets is cut first: then Spark can split the bucket's rows over tasks.
    shared = cut(buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket"))
    buckets = cut(buckets.join(shared, "bucket"))
    ids = cut(buckets.select("rep").distinct())
    sets = cut(alike.join(ids, "rep").select("rep", "least", "fp1", "fp2", "bands").join(texts.select(F.col("doc_id").alias("least"), "text"), "least").mapInArrow(set_maker(width), "rep long, bands array<bigint>, elements array<bigint>"))

    def checked(pairs: DataFrame) -> DataFrame:
        small = sets.select("rep", "elements")
        rows = pairs.join(small.toDF("b", "b_set"), "b").join(small.toDF("a", "a_set"), "a").select("a", "b", "a_set", "b_set")
        return rows.mapInArrow(pair_checker(percent), "a long, b long")

    def split(now: DataFrame, *lead: Column) -> DataFrame:
        """Per bucket in which several components meet: the largest (top), all members and their shingles, and those of the rest."""
        per = now.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), *lead)
        extra = ["lead"] if lead else []
        order = [-F.col("lead.h"), "comp", "lead"] if lead else ["comp"]
        met = per.groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max(F.struct("n", *order, "weight")).alias("top")).where("comps > 1")
        return cut(met.select("bucket", F.col("top.comp").alias("top"), "n", "weight", (F.col("n") - F.col("top.n")).alias("rest"), (F.col("weight") - F.col("top.weight")).alias("rest_weight"), *[F.col(f"top.{c}") for c in extra]))

    def placed(comps: DataFrame | None) -> DataFrame:
        """Members of buckets with their components; before the first links each is its own, and buckets stay where they lie."""
        return buckets.withColumn("comp", F.col("rep")) if comps is None else buckets.join(comps, "rep")

    links, comps = spark.createDataFrame([], "a long, b long"), None
    for seed in range(ROUNDS):
        now = placed(comps)
        stars = split(now, F.min(F.struct(F.xxhash64(F.lit(seed), "rep").alias("h"), "rep")).alias("lead"))
        pairs = now.join(stars.select("bucket", "top", "lead"), "bucket").where("comp <> top").groupBy(F.col("rep").alias("b")).agg(F.min("lead").alias("lead")).select(F.col("lead.rep").alias("a"), "b")
        found = cut(checked(pairs))
        if found.isEmpty():
            break
        links = links.unionByName(found)
        comps = cut(connected_components(ids.withColumnRenamed("rep", "id"), links).toDF("rep", "comp"))

    now = placed(comps)
    parts = lambda n, weight, most: F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(weight) / SHINGLES))
    met = split(now).select("bucket", "top", parts("n", "weight", BLOCK).alias("blocks"), parts("rest", "rest_weight", PROBES).alias("parts"))
    open_ = cut(now.join(met, "bucket"))
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    members = open_.select("bucket", "band", place("block", "blocks").alias("block"), every("parts").alias("part"), "rep", "comp", F.lit(False).alias("probe"))
    probes = open_.where("comp <> top").select("bucket", "band", every("blocks").alias("block"), place("part", "parts").alias("part"), "rep", "comp", F.lit(True).alias("probe"))
    rows = members.unionByName(probes).join(sets, "rep").repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part")
    last = cut(rows.mapInArrow(block_checker(percent), "a long, b long"))
    if not last.isEmpty():
        comps = connected_components(ids.withColumnRenamed("rep", "id"), links.unionByName(last)).toDF("rep", "comp")

    classes = alike.withColumnRenamed("least", "component_id")
    if comps is not None:
        named = cut(comps.join(alike.select("rep", "least"), "rep"))
        lowest = named.groupBy("comp").agg(F.min("least").alias("lowest"))
        lower = maybe_broadcast(cut(named.join(lowest, "comp").where("lowest < least").select("rep", "lowest")))
        classes = alike.join(lower, "rep", "left").withColumn("component_id", F.coalesce("lowest", "least"))
    classes = classes.select("fp1", "fp2", "n_shingles", "component_id")
    out = signed.select("doc_id", "n_shingles", "fp1", "fp2", "text_key").join(classes, ["fp1", "fp2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key")


def op8(docs: DataFrame) -> DataFrame:
    """Documents at 3-word shingles and 0.85: doc_id, n_shingles, component_id, kept."""
    out = near_duplicates(docs, width=3, percent=85)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
