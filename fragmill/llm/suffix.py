"""Repeated passages by a distributed enhanced suffix array.

A window is a string of ``length`` bytes.  Dealing: the leftmost k-gram of
smallest hash is a window's anchor, and neighbouring windows with one anchor
form a segment of text.  Equal windows have equal anchors, so segments that
meet under one anchor hash hold every occurrence of their windows, whichever
documents they come from, and segments whose anchor hash is met once cannot
repeat and go no further.  Segments equal byte for byte travel as one with its
multiplicity, which keeps groups of copies small before the shuffle.

Each task builds a suffix array over its segments' windows (prefix doubling
over ranks of 8 to 128 bytes), the array of longest common prefixes, and scans
it with a stack for its interval tree.  An interval of at least ``length`` is
a maximal repeat if its suffixes differ in the byte to their left (the start
of a segment differs from everything); all its suffixes are its occurrences.
What the maximal repeats cover is what some window covers that also starts
elsewhere: a window that is no interval's start extends to the left until one.
Repeats end at the end of their segment; the next segment's repeats continue
them, and covered spans are merged per document.

An anchor met so often that its segments could exceed ``BLOCK`` is hot.  Its
segments are dealt over several tasks by their own hash and taken in blocks of
``BLOCK`` bytes, by the hashes of their windows: what a block holds twice is
covered, what it holds once is asked of the other blocks of the anchor, by one
row for each window.  So neither a task nor a window's rows grow with the
number of segments that an anchor has: a window has one row for each block.

Rows equal in doc_id and text are counted first: one of them is dealt, so that
others meet its windows, and all of them are covered whole if a window fits.
Different rows are told apart by 96 bits of hashes.

What a hot key meets in a join is cut first, so that Spark can split the key's
rows over tasks.

Null texts are empty; texts shorter than a window have no repeats.  Different
rows that share a doc_id are documents of their own.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.llm import bytesops as B
from fragmill.llm.runtime import cut, maybe_broadcast

#: Bytes of an anchor's k-gram.
K = 32
#: Bytes of segments in one suffix array or block of a hot anchor; one more anchor that is not hot may come on top.
BLOCK = 2 << 20
#: Longest piece of a document whose windows are dealt at once.
PIECE = 1 << 22
_PLACE = B.U64((1 << 24) - 1)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and anchor hash of each segment.

    ``data`` holds whole documents of less than 2**24 bytes together.
    """
    none = np.zeros(0, np.int64)
    m = len(data) - length + 1
    if m <= 0:
        return none, none, none, none.view(B.U64)
    prefix = B.prefix_hash(data)
    g = B.mix64((prefix[k:] - prefix[:-k]) * B.powers(len(data) - k + 1, "down"))
    low = (g & ~_PLACE) | np.arange(len(g), dtype=B.U64)
    width, have = length - k + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    place = (low[:m] & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    ok = np.arange(m) + length <= offsets[row + 1]
    fresh = ok.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | ~ok[:-1] | (row[1:] != row[:-1])
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return none, none, none, none.view(B.U64)
    counts = np.add.reduceat(ok.astype(np.int64), starts)
    return row[starts], starts - offsets[row[starts]], counts, g[place[starts]]


def document_segments(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of the segments of one document of any size."""
    parts = []
    for at in range(0, max(1, len(text) - length + 1), PIECE):
        piece = text[at : at + PIECE + length - 1]
        _, first, count, h = segments(piece, np.array([0, len(piece)]), length)
        parts.append((first + at, count, h))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _dealt(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch.column("text"))
            for i, j in B.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if j - i == 1 and len(part) > PIECE:
                    first, count, h = document_segments(part, length)
                    row = np.zeros(len(first), np.int64)
                else:
                    row, first, count, h = segments(part, at, length)
                uid, mark = (batch.column(c).slice(i, j - i).to_numpy()[row] for c in ("uid", "mark"))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(uid), pa.array(mark), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], names=["h", "uid", "mark", "first", "windows"])

    return run


def _prints(text: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return B.span_hash(B.prefix_hash(text), first, ends).view(np.int64)


def _cut_out(length: int, bodies: bool):
    """Segments of each document: with ``bodies``, the first of equal ones of a task carries its bytes, and the second and one with another left byte none.

    The part is 0, or for a hot anchor from 1 by the segment's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            data, offsets = B.text_bytes(batch.column("text"))
            runs = batch.column("runs")
            uids, marks = (batch.column(c).to_numpy() for c in ("uid", "mark"))
            edges = runs.offsets.to_numpy() - runs.offsets[0].as_py()
            flat = runs.flatten()
            h, first, windows = (flat.field(c).to_numpy() for c in ("h", "first", "windows"))
            out = []
            for k in range(batch.num_rows):
                a, b = edges[k], edges[k + 1]
                text = data[offsets[k] : offsets[k + 1]]
                ends = first[a:b].astype(np.int64) + windows[a:b] + length - 1
                fp = _prints(text, first[a:b].astype(np.int64), ends)
                if not bodies:
                    out.append((fp, np.full(b - a, uids[k]), np.full(b - a, marks[k]), first[a:b]))
                    continue
                raw = text.tobytes()
                parts = flat.field("parts").to_numpy()[a:b].astype(np.int64)
                part = np.where(parts > 0, fp % np.maximum(parts, 1) + 1, 0)
                for x, f, s, e, p in zip(h[a:b].tolist(), fp.tolist(), first[a:b].tolist(), ends.tolist(), part.tolist(), strict=True):
                    n, left = seen.get(f, (0, 0))
                    own = raw[s - 1] if s else -1
                    if n < 2 or (n == 2 and own != left):
                        seen[f] = (n + 1, own)
                        out.append((x, f, None if n else raw[s:e], own, p))
                if len(seen) > 1_000_000:
                    seen.clear()
            if bodies:
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int16()), pa.array(cols[4], pa.int32())], names=["h", "fp", "body", "left", "part"])
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["fp", "uid", "mark", "first"])

    return run


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    step = np.ones(len(key), np.int64)
    step[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(len(key), B.U64)
    out[order] = np.cumsum(step).astype(B.U64)
    return out


class SuffixArray:
    """Suffixes that start a window, in order, and the common prefix of each with the one before (0 if below ``length``).

    A segment's end sorts before every byte and is unlike any other end.
    """

    def __init__(self, bodies: list[bytes], length: int):
        sizes = np.array([len(x) for x in bodies], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = int(self.ends[-1])
        self.text = np.zeros(n + length + 8, np.uint8)
        self.text[:n] = np.frombuffer(b"".join(bodies), np.uint8)
        self.word = np.zeros(n + length, B.U64)
        for k in range(8):
            self.word = self.word << B.U64(8) | self.text[k : k + len(self.word)]
        rank, at = _ranks(self.word), 8
        while 2 * at <= length:
            rank = _ranks(rank[: len(rank) - at] << B.U64(32) | rank[at:])
            at *= 2
        counts = np.maximum(sizes - length + 1, 0)
        segment = np.repeat(np.arange(len(bodies)), counts)
        place = self.starts[segment] + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        key = rank[place] << B.U64(32) | rank[place + length - at]
        order = np.argsort(key)
        key = key[order]
        self.place, self.segment = place[order], segment[order]
        self.lcp = np.zeros(len(key), np.int64)
        tie = np.zeros(len(key), bool)
        tie[1:] = key[1:] == key[:-1]
        self._order_ties(tie, length)

    def _order_ties(self, tie: np.ndarray, at: int) -> None:
        """Orders runs of equal windows by their further text, 8 bytes a step, and fills in their common prefixes."""
        group = np.cumsum(~tie)
        open_ = np.flatnonzero(tie | np.concatenate([tie[1:], [False]]))
        while len(open_):
            p, s, g = self.place[open_], self.segment[open_], group[open_]
            room = np.clip(self.ends[s] - p - at, 0, 8)
            word = self.word[np.minimum(p + at, len(self.word) - 1)]
            gone = (8 * (8 - room)).astype(B.U64)
            word = np.where(room > 0, (word >> np.minimum(gone, B.U64(63))) << np.minimum(gone, B.U64(63)), B.U64(0))
            order = np.lexsort((room, word, g))
            word, room = word[order], room[order]
            self.place[open_], self.segment[open_] = p[order], s[order]
            pair = g[1:] == g[:-1]
            same = np.zeros(len(open_), bool)
            same[1:] = pair & (word[1:] == word[:-1]) & (room[1:] == 8) & (room[:-1] == 8)
            settled = np.flatnonzero(pair & ~same[1:]) + 1
            apart = (word[settled] ^ word[settled - 1]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
            first = np.where(apart.any(axis=1), apart.argmax(axis=1), 8)
            self.lcp[open_[settled]] = at + np.minimum(first, np.minimum(room[settled], room[settled - 1]))
            group[open_] = np.cumsum(~same)
            open_ = open_[same | np.concatenate([same[1:], [False]])]
            at += 8


def maximal_repeats(bodies: list[bytes], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Common length and occurrences (segment, offset) of each maximal repeat among the segments.

    The start of a segment counts as unlike any other left neighbour, as what lies to its left is another segment's.
    """
    sa = SuffixArray(bodies, length)
    n = len(sa.place)
    if not n:
        return
    offset = sa.place - sa.starts[sa.segment]
    left = np.where(offset > 0, sa.text[np.maximum(sa.place - 1, 0)].astype(np.int64), -1 - np.arange(n))
    heads = np.flatnonzero(sa.lcp == 0)
    sizes = np.diff(np.concatenate([heads, [n]]))
    diverse = np.minimum.reduceat(left, heads) != np.maximum.reduceat(left, heads)
    for head, size in zip(heads[diverse & (sizes > 1)].tolist(), sizes[diverse & (sizes > 1)].tolist(), strict=True):
        lcp = sa.lcp[head : head + size].tolist() + [0]
        own = left[head : head + size].tolist()
        stack: list[tuple[int, int, object]] = []
        # The third entry is the one left byte of the interval so far, or None if it has several.
        for k in range(1, size + 1):
            start, common = k - 1, own[k - 1]
            while stack and stack[-1][0] > lcp[k]:
                depth, start, kind = stack.pop()
                common = kind if kind == common else None
                if common is None:
                    yield depth, [(int(sa.segment[head + x]), int(offset[head + x])) for x in range(start, k)]
            if lcp[k]:
                if stack and stack[-1][0] == lcp[k]:
                    depth, start, kind = stack.pop()
                    common = kind if kind == common else None
                stack.append((lcp[k], start, common))


_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _answers(h: object, fp: object, ranges: object, w: object, at: object) -> pa.RecordBatch:
    cols = zip((h, fp, ranges, w, at), (pa.int64(), pa.int64(), _RANGES, pa.int64(), pa.int32()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["h", "fp", "ranges", "w", "at"])


def _grouped(key: object, depth: object, goes_on: object, fp: object, at: object) -> pa.RecordBatch:
    cols = zip((key, depth, goes_on, fp, at), (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["repeat", "depth", "goes_on", "fp", "at"])


def window_prints(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, offset and hash of each window of the segments."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    starts = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    segment = np.repeat(np.arange(len(bodies)), windows)
    at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    place = starts[segment] + at
    prefix = B.prefix_hash(np.frombuffer(b"".join(bodies), np.uint8))
    return segment, at, B.span_hash(prefix, place, place + length).view(np.int64)


def hot_block(h: int, fps: list[int], bodies: list[bytes], counts: list[int], length: int) -> Iterator[pa.RecordBatch]:
    """What a block of a hot anchor knows of its distinct segments, and its windows for the other blocks.

    A window that the block holds twice, or that lies in a segment met twice,
    has a row without fp; one that it holds once has a row that asks for more.
    """
    sizes = [len(b) for b in bodies]
    segment, at, prints = window_prints(bodies, length)
    w, back, n = np.unique(prints, return_inverse=True, return_counts=True)
    copied = np.array(counts) > 1
    told = n > 1
    told[back[copied[segment]]] = True
    known = told[back] & ~copied[segment]
    # Runs of known windows; copied segments are covered whole.
    fresh, last = known.copy(), known.copy()
    fresh[1:] &= ~known[:-1] | (segment[1:] != segment[:-1])
    last[:-1] &= ~known[1:] | (segment[1:] != segment[:-1])
    spans: dict[int, list[dict[str, int]]] = {int(k): [{"a": 0, "b": int(sizes[k])}] for k in np.flatnonzero(copied)}
    for k, a, b in zip(segment[fresh].tolist(), at[fresh].tolist(), at[last].tolist(), strict=True):
        spans.setdefault(k, []).append({"a": a, "b": b + length})
    yield _answers([h] * len(spans), [fps[k] for k in spans], list(spans.values()), [fps[k] for k in spans], [None] * len(spans))
    say = w[told]
    ask = ~told[back]
    for i in range(0, len(say), 1 << 16):
        m = len(say[i : i + (1 << 16)])
        yield _answers([h] * m, [None] * m, [None] * m, say[i : i + m], [None] * m)
    fp, asked, offset = np.array(fps, np.int64)[segment[ask]], w[back[ask]], at[ask]
    for i in range(0, len(fp), 1 << 16):
        m = len(fp[i : i + (1 << 16)])
        yield _answers(np.full(m, h), fp[i : i + m], [None] * m, asked[i : i + m], offset[i : i + m])


def _covered(length: int, groups: bool = False):
    """Rows sorted by h, part and fp to the ranges of each segment that maximal repeats cover, or for hot anchors what ``hot_block`` gives.

    With ``groups`` the repeats themselves instead: one row for each occurrence
    (repeat, depth, goes_on, fp, at), where a hot anchor's are its windows, met or not.
    """

    def flush(group: list[tuple[int, int, bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        spans: list[list[list[int]]] = [[[0, len(b)]] if n > 1 else [] for _, _, b, _, n in group]
        per: dict[int, list[int]] = {}
        for k, (h, *_) in enumerate(group):
            per.setdefault(h, []).append(k)
        mixed = [k for own in per.values() if len(own) > 1 or groups for k in own]
        told: list[tuple[int, int, bool, int, int]] = []
        bodies = [group[k][2] for k in mixed]
        for depth, found in maximal_repeats(bodies, length) if mixed else ():
            if groups:
                k, at = found[0]
                key = int(_prints(np.frombuffer(bodies[k][at : at + depth], np.uint8), np.array([0]), np.array([depth]))[0])
                # The byte before each occurrence: of the segment, or what is known to stand before all of the segment's copies.
                before = {bodies[k][at - 1] if at else group[mixed[k]][3] for k, at in found}
                goes_on = len(before) == 1 and min(before) >= 0
                told += [(key, depth, goes_on, group[mixed[k]][1], at) for k, at in found]
            else:
                for segment, offset in found:
                    spans[mixed[segment]].append([offset, offset + depth])
        if groups:
            # A segment that several rows have is a repeat even where no other segment shares its windows.
            told += [(fp, len(body), left >= 0, fp, 0) for _, fp, body, left, n in group if n > 1]
            yield _grouped(*(list(zip(*told, strict=True)) or [[]] * 5))
        if not groups:
            rows = [(group[k][0], group[k][1], [{"a": a, "b": b} for a, b in merged(s)]) for k, s in enumerate(spans) if s]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield _answers(*cols, cols[1], [None] * len(rows))

    def settle(group: list[tuple[int, int, bytes, int, int]], hot: bool) -> Iterator[pa.RecordBatch]:
        if hot and groups:
            segment, at, w = window_prints([g[2] for g in group], length)
            fp = np.array([g[1] for g in group], np.int64)[segment]
            for i in range(0, len(w), 1 << 16):
                m = len(w[i : i + (1 << 16)])
                yield _grouped(w[i : i + m], np.full(m, length), [None] * m, fp[i : i + m], at[i : i + m])
        elif hot:
            _, fps, bodies, _, counts = zip(*group, strict=True)
            yield from hot_block(group[0][0], list(fps), list(bodies), list(counts), length)
        elif group:
            yield from flush(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, bytes, int, int]] = []
        size, hot = 0, 0
        for batch in batches:
            for h, fp, body, left, part in zip(*(batch.column(c).to_pylist() for c in ("h", "fp", "body", "left", "part")), strict=True):
                if group and group[-1][:2] == (h, fp):
                    last = group[-1]
                    group[-1] = (h, fp, last[2] or body, left if left == last[3] else -1, last[4] + 1)
                    size += len(body or b"") if last[2] is None else 0
                    continue
                other = bool(group) and group[-1][0] != h
                if part != hot or (hot and other) or (size > BLOCK and (hot or other)):
                    yield from settle(group, hot > 0)
                    group, size, hot = [], 0, part
                group.append((h, fp, body, left, 1))
                size += len(body or b"")
        yield from settle(group, hot > 0)

    return run


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _spans(length: int):
    """uid, doc_id, text and covered spans to the document's rows of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = B.text_bytes(batch.column("text"))
            raw = data.tobytes()
            rows = []
            for k, found in enumerate(batch.column("found").to_pylist()):
                text = raw[offsets[k] : offsets[k + 1]]
                spans = merged([[x["a"], x["b"]] for x in found or ()])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


_KEY = ["uid", "mark"]


def _prepared(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts; keys (uid, mark) of rows that are there more than once; and per dealt text its segments whose anchor hash is met more than once."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumns({"uid": F.xxhash64("doc_id", "text"), "mark": F.hash("text", "doc_id")})
    copies = cut(texts.groupBy(*_KEY).count().where("count > 1").select(*_KEY))
    once = texts
    if not copies.isEmpty():
        small = maybe_broadcast(copies)
        once = texts.join(small, _KEY, "left_anti").unionByName(texts.join(small, _KEY, "left_semi").groupBy(*_KEY).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select(texts.columns))
    dealt = once.select(*_KEY, "text").mapInArrow(_dealt(length), "h long, uid long, mark int, first int, windows int")
    # An anchor's segments have at most 2 * length - K bytes each; 0 parts mean that it is not hot.
    most = max(1, BLOCK // (2 * length - K))
    parts = F.when(F.col("n") > most, F.least(F.ceil(F.col("n") / most), F.lit(1 << 30))).otherwise(0).cast("int")
    again = cut(dealt.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", parts.alias("parts")))
    runs = dealt.join(again, "h").groupBy(*_KEY).agg(F.collect_list(F.struct("h", "first", "windows", "parts")).alias("runs"))
    return texts, copies, once.join(runs, _KEY).select(*_KEY, "text", "doc_id", "runs")


def _segments(held: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The distinct segments with their bytes, dealt by anchor, and every document's segments (fp, uid, mark, first)."""
    first_of_each = held.mapInArrow(_cut_out(length, True), "h long, fp long, body binary, left short, part int")
    members = held.mapInArrow(_cut_out(length, False), "fp long, uid long, mark int, first int")
    return first_of_each.repartition("h", "part").sortWithinPartitions("h", "part", "fp"), members


def repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte offsets) of every row of ``docs(doc_id, text)``.

    The spans are the merged occurrences of all maximal repeats of at least ``length`` bytes.
    """
    texts, copies, held = _prepared(docs, length)
    ordered, members = _segments(held, length)
    answers = ordered.mapInArrow(_covered(length), "h long, fp long, ranges array<struct<a:int,b:int>>, w long, at int")
    one = F.array(F.struct(F.col("at").alias("a"), (F.col("at") + length).alias("b")))
    met = answers.withColumn("n", F.count("*").over(Window.partitionBy("h", "w"))).where("fp IS NOT NULL AND (at IS NULL OR n > 1)")
    # A segment's hash stands for its bytes, and so for its anchor.
    covered = met.select("fp", F.coalesce("ranges", one).alias("ranges"))
    shifted = F.transform("ranges", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"]).alias("b")))
    found = members.join(covered, "fp").groupBy(*_KEY).agg(F.flatten(F.collect_list(shifted)).alias("found"))
    once, again = texts, None
    if not copies.isEmpty():
        small = maybe_broadcast(copies)
        once, again = texts.join(small, _KEY, "left_anti"), texts.join(small, _KEY, "left_semi")
    rows = once.join(found, _KEY, "left").select("doc_id", "text", "found")
    if again is not None:
        size = F.octet_length("text")
        rows = rows.unionByName(again.select("doc_id", "text", F.when(size >= length, F.array(F.struct(F.lit(0).alias("a"), size.alias("b")))).alias("found")))
    key = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_spans(length), f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")


def repeat_groups(docs: DataFrame, length: int = 200) -> DataFrame:
    """repeat (a hash of its bytes), depth (bytes), goes_on, doc_id and start (byte offset) of every occurrence of every maximal repeat.

    Repeats are maximal within the segments of one anchor: a longer one appears
    as the pieces that its anchors cut, and goes_on says that a piece has one
    byte before all its occurrences, so that another piece ends there.  An
    anchor met more often than ``BLOCK`` allows gives its repeated windows, with
    goes_on null.  Of rows equal in doc_id and text one is listed.  Each group
    has two occurrences at least.
    """
    _, _, held = _prepared(docs, length)
    ordered, members = _segments(held, length)
    told = cut(ordered.mapInArrow(_covered(length, True), "repeat long, depth int, goes_on boolean, fp long, at int").groupBy("repeat", "depth", "fp", "at").agg(F.min("goes_on").alias("goes_on")))
    places = members.join(told, "fp").groupBy("repeat", "depth", *_KEY, (F.col("first") + F.col("at")).alias("start")).agg(F.min("goes_on").alias("goes_on"))
    places = cut(places.join(held.select(*_KEY, "doc_id"), _KEY))
    many = cut(places.groupBy("repeat", "depth").agg(F.count("*").alias("n"), F.min("goes_on").alias("goes_on")).where("n > 1").drop("n"))
    return places.drop("goes_on").join(many, ["repeat", "depth"]).select("repeat", "depth", "goes_on", "doc_id", "start")


def op6(docs: DataFrame) -> DataFrame:
    return repeats(docs).drop("spans")
