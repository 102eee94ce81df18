"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Words are runs of ASCII digits and letters (lower-cased) and of all bytes from
0x80 on.  An item's windows are its runs of ``window`` words (an item of
fewer words is one window).  The automaton holds blocks of the items' words, at
least one of which lies in every window; a document is scanned once, each match
is extended to the words on either side, and what is as long as a window maps
back over the words' numbers to byte offsets of the original text.

The automaton's source is bounded: items are dealt into slices of about
``SLICE_BYTES`` of text, normally one.  Each slice is broadcast alone and adds
its hits to what earlier slices found, in one pass over the documents without
a shuffle.

Null and empty texts have no words and no hits.  Rows that repeat a doc_id
are judged one by one.  Items without words or without an id are ignored;
items that repeat an id count once.  An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.llm import bytesops as B

#: Most text of the items of one automaton: about 40 bytes of memory for each.
SLICE_BYTES = 8 << 20

#: Inside a word: digits, letters and all bytes from 0x80 on.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TABLE = bytes(int(B.LOWER[b]) if IN_WORD[b] else 0x20 for b in range(256))

_built: dict[str, tuple] = {}


def normal(text: bytes) -> bytes:
    """Lower-cased words with single spaces between."""
    return b" ".join(text.translate(_TABLE).split())


def build(items: list[tuple[str, str]], window: int):
    """The automaton, per pattern its places (item, first word), and per item its id and words.

    A run of ``window`` words of an item holds a whole block of its words, if
    blocks of (window + 1) / 2 words are cut from its start on; so the blocks
    are the patterns, about one node for each letter of the items, and the scan
    extends each match to both sides.  An item of fewer words is one pattern.
    """
    block = (window + 1) // 2
    places: dict[bytes, list[tuple[int, int]]] = {}
    known: list[tuple[str, list[bytes]]] = []
    for item, text in items:
        words = normal(text.encode()).split()
        starts, size = (range(0, len(words) - block + 1, block), block) if len(words) >= window else (range(1 if words else 0), len(words))
        for k in starts:
            places.setdefault(b" ".join(words[k : k + size]), []).append((len(known), k))
        known.append((item, words))
    machine = ahocorasick.Automaton()
    for k, line in enumerate(places):
        machine.add_word(f" {line.decode('latin-1')} ", k)
    if places:
        machine.make_automaton()
    return machine if places else None, [len(x) + 2 for x in places], list(places.values()), known


def matches(line: bytes, built: tuple, window: int) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs (first word, word after the last) of a normalised document that some item has too, and the ids of these items.

    Each item is followed along a diagonal (place in the document less place in
    the item) once, however many of its blocks match there.
    """
    machine, chars, places, known = built
    hits = list(machine.iter(f" {line.decode('latin-1')} ")) if machine and line else ()
    if not hits:
        return [], set()
    words = line.split(b" ")
    spaces = np.flatnonzero(np.frombuffer(b" " + line, np.uint8) == 0x20)
    past: dict[tuple[int, int], int] = {}
    runs, found = set(), set()
    for (end, k), at in zip(hits, np.searchsorted(spaces, [end - chars[k] + 1 for end, k in hits]).tolist(), strict=True):
        for item, first in places[k]:
            name, own = known[item]
            if at < past.get((item, at - first), 0):
                continue
            a, b, p, q = at, at, first, first
            while a and p and words[a - 1] == own[p - 1]:
                a, p = a - 1, p - 1
            while b < len(words) and q < len(own) and words[b] == own[q]:
                b, q = b + 1, q + 1
            past[item, at - first] = b
            if b - a >= min(window, len(own)):
                runs.add((a, b))
                found.add(name)
    return sorted(runs), found


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def scanner(items, window: int, prefix: str):
    """Adds the matches of a broadcast slice of items to the columns n_words, runs and found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(repr((window, items.value)).encode()).hexdigest()
        if key not in _built:
            _built.clear()
            _built[key] = build(items.value, window)
        for batch in batches:
            data, offsets = B.text_bytes(batch.column("text"))
            raw = data.tobytes()
            counts, runs, found = [], batch.column(f"{prefix}runs").to_pylist(), batch.column(f"{prefix}found").to_pylist()
            for k in range(len(runs)):
                line = normal(raw[offsets[k] : offsets[k + 1]])
                counts.append(line.count(b" ") + 1 if line else 0)
                spans, names = matches(line, _built[key], window)
                if not spans:
                    continue
                steps = np.zeros(counts[-1] + 1, np.int64)
                for first, past in [*spans, *((x["first"], x["past"]) for x in runs[k])]:
                    steps[first] += 1
                    steps[past] -= 1
                first, past = _runs(np.cumsum(steps)[:-1] > 0)
                at, to, _ = B.word_spans(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]), IN_WORD)
                runs[k] = [{"first": a, "past": b, "start": int(at[a]), "end": int(to[b - 1])} for a, b in zip(first.tolist(), past.tolist(), strict=True)]
                found[k] = sorted(names.union(found[k]))
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            told = {"n_words": pa.array(counts, pa.int64()), "runs": pa.array(runs, batch.schema.field(f"{prefix}runs").type), "found": pa.array(found, batch.schema.field(f"{prefix}found").type)}
            out |= {f"{prefix}{c}": x for c, x in told.items()}
            yield pa.RecordBatch.from_arrays([out[c] for c in batch.schema.names], names=batch.schema.names)

    return run


def scan(docs: DataFrame, items: DataFrame, window: int = 13, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, runs (hit runs by word number and byte offset) and found (item ids as strings).

    ``docs`` needs a text column, ``items`` item_id and text.  The three names
    carry ``prefix``; columns of these names in ``docs`` are replaced, all
    others stay.
    """
    spark: SparkSession = docs.sparkSession
    own = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    slices = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES))
    added = {"n_words": F.lit(None).cast("long"), "runs": F.array().cast("array<struct<first:int,past:int,start:int,end:int>>"), "found": F.array().cast("array<string>")}
    out = docs.withColumns({f"{prefix}{c}": x for c, x in added.items()})
    for k in range(slices):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        out = out.mapInArrow(scanner(spark.sparkContext.broadcast([tuple(r) for r in rows]), window, prefix), out.schema)
    return out


def words_hit(runs: Column | str) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda total, x: total + x["past"] - x["first"])


def measured(scanned: DataFrame) -> DataFrame:
    """Adds n_hit (words inside hit runs) and contaminated (a twentieth of the words or more) to what ``scan`` gives without a prefix."""
    return scanned.withColumn("n_hit", words_hit("runs")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, window: int = 13, least: int = 5) -> DataFrame:
    """``docs`` without those that hold a passage of the benchmark, whatever their length; their columns stay as they are.

    A run of ``least`` hit words or more is a passage.  A shorter run, which
    only an item of fewer words can leave, counts where hits make up a
    twentieth of the document or more, so a common phrase that some item
    consists of does not empty the corpus.
    """
    own = "__scan_"
    scanned = scan(docs, items, window, own)
    hit = words_hit(f"{own}runs")
    leak = F.exists(f"{own}runs", lambda r: r["past"] - r["first"] >= least) | ((hit > 0) & (20 * hit >= F.col(f"{own}n_words")))
    return scanned.where(~leak).select(docs.columns)


def op9(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = measured(scan(docs.select("doc_id", "text"), items))
    return out.select("doc_id", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "found"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, k, iw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
words AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT r, k, unnest(range(0, n)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
