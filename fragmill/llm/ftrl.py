"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs
with one word between them, in a table of 2**bits coordinates.  Each
coordinate has its own learning rate, and the L1 term keeps most weights at
exactly zero (McMahan and others, 2013), so what is broadcast for scoring is
the short list of the others, at most 2**bits of them.

Fitting reads a bounded sample of labelled documents (``max_rows``, by a hash
of doc_id), in one task and in a fixed order, so reruns agree; scoring reads
whole texts where they lie, without a shuffle.

Null and empty texts have no features and get the score of the bias.  Rows
that repeat a doc_id are scored one by one, and rows that also repeat its text
teach once.  Of several labels of a document the highest counts (toxic if any
says so).  Labels that are null, or whose document is missing, teach nothing;
with no labels at all every score is 0.5.  A null doc_id teaches nothing and
counts as held out.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.llm import bytesops as B
from fragmill.llm.decontam import IN_WORD
from fragmill.llm.runtime import sampled

#: Rate, L1 term, class weight and passes were chosen by cross-validation over the four folds that may be learnt, and by how few clean documents samples of 70 rows take.
BITS = 22
ALPHA, BETA, L2 = 1.0, 1.0, 0.5
#: The L1 term grows with the square root of the rows, as the noise of a coordinate that means nothing does.
L1_ROOT = 0.25
#: Toxic documents are the rarer class; each counts so many times.
POSITIVE = 2.0
MAX_ROWS, EPOCHS = 16_000, 3


def grams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all words, word pairs and skip-pairs, and the row of each."""
    words, first = B.word_hashes(data, offsets, IN_WORD)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = B.U64(64 - bits)
    out, rows = [words >> shift], [row]
    for gap, salt in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        if len(words) > gap:
            same = row[:-gap] == row[gap:]
            out.append((B.mix64(words[:-gap] * B.U64(salt) + words[gap:]) >> shift)[same])
            rows.append(row[:-gap][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(rows)


def featurise(bits: int):
    """Distinct coordinates of each sampled row; rows of one h are told once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = [k for k, h in enumerate(batch.column("h").to_pylist()) if not (h in seen or seen.add(h))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            data, offsets = B.text_bytes(batch.column("text"))
            for i, j in B.slices(offsets):
                at, row = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                key = np.unique(row << bits | at)
                ends = np.searchsorted(key >> bits, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((key & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(i, j - i), batch.column("label").slice(i, j - i), lists], names=["h", "label", "features"])

    return run


def learn(rows: list[tuple[float, np.ndarray]], bits: int, epochs: int) -> tuple[np.ndarray, float]:
    """Weights by coordinate and bias after online passes over ``rows`` (label, distinct coordinates)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = grad = 0.0
    l1 = L1_ROOT * len(rows) ** 0.5
    for _ in range(epochs):
        for y, at in rows:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + root) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y) * (POSITIVE if y > 0.5 else 1.0)
            sigma = (np.sqrt(ni + g * g) - root) / ALPHA
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
            grad += g * g
            bias -= 0.1 * g / (1 + grad**0.5)
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)), bias


def trainer(bits: int, epochs: int):
    """One task's rows, in the order of h and each h once, to rows of coordinate and weight; the bias stands at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            features = batch.column("features")
            for k, (h, y) in enumerate(zip(batch.column("h").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                if h != last:
                    rows.append((y, features[k].values.to_numpy(zero_copy_only=False).astype(np.int32)))
                last = h
        if rows:
            weights, bias = learn(rows, bits, epochs)
            at = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([[bias], weights[at]]))], names=["at", "weight"])

    return run


def learnable(doc_id: Column | str, folds: int, held: int) -> Column:
    """Whether labels of this document may be learnt: crc32 of doc_id as text, modulo ``folds``, is not ``held``; never for a null doc_id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """h, text and label of at most about ``max_rows`` labelled documents, by a hash of doc_id.

    The sample's ids are bounded by ``max_rows`` and so may be broadcast; no text is shuffled to find them.
    h tells different texts of one doc_id apart.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learnable("doc_id", 5, 0)).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    share = min(1.0, max_rows / max(1, known.count()))
    ids = known.where(sampled(F.xxhash64(F.lit("sample"), "doc_id"), share))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.xxhash64(F.lit("row"), "doc_id", "text").alias("h"), "text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and weights that are not zero, and the bias."""
    sample = labelled_sample(docs, labels, label, max_rows)
    rows = sample.mapInArrow(featurise(bits), "h long, label double, features array<int>")
    found = rows.repartition(1).sortWithinPartitions("h").mapInArrow(trainer(bits, epochs), "at long, weight double").toPandas()
    at, weight = found["at"].to_numpy(np.int64), found["weight"].to_numpy(float)
    bias = float(weight[at < 0][0]) if (at < 0).any() else 0.0
    return at[at >= 0], weight[at >= 0], bias


def score_texts(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, table: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """Scores of whole texts; ``known`` marks the coordinates whose weight in ``table`` is not zero."""
    total = np.full(len(offsets) - 1, bias)
    for i, j in B.slices(offsets):
        at, row = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
        hit = known[at]
        key = np.unique(row[hit] << bits | at[hit])
        total[i:j] += np.bincount(key >> bits, table[key & ((1 << bits) - 1)], minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS, into: str = "score") -> DataFrame:
    """``docs`` (with a text column) and a column ``into``, the score; a column of that name is replaced, all others stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, bias = held.value
        table = np.zeros(1 << bits)
        table[at] = weight
        known = table != 0
        for batch in batches:
            scores = pa.array(score_texts(*B.text_bytes(batch.column("text")), known, table, bias, bits))
            yield pa.RecordBatch.from_arrays([scores if c == into else x for c, x in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    out = docs.withColumn(into, F.lit(None).cast("double"))
    return out.mapInArrow(run, out.schema)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (~learnable("doc_id", 5, 0)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
