"""Vectorised kernels over whole texts as UTF-8 bytes in Arrow buffers.

A batch of texts is one byte array with document offsets.  Words are found
with look-up tables and hashed by differences of one running polynomial, so no
Python loop runs over words or characters.  Work proceeds in slices of about
``SLICE`` bytes; a longer document forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: True for bytes inside a word: all but space and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII upper case to lower case, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int, which: str = "up") -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        steps = np.full(max(n, SLICE + 1), _BASE if which == "up" else _INVERSE, U64)
        steps[0] = 1
        _powers[which] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if ends is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most_bytes: int = SLICE, most_rows: int = 8192) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` bytes, in order, covering all rows."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, n)
        yield at, to
        at = to


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial P with P[0] = 0, so that any span hashes from its two ends."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, by content and length alone."""
    down = powers(len(prefix), "down")
    h = (prefix[ends] - prefix[starts]) * down[starts]
    h ^= (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix64(h)


def word_spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, per document, the index of its first word (one entry more than documents)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = keep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = NOT_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of each document's first word."""
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, keep)
    return span_hash(prefix_hash(data), starts, ends), first
