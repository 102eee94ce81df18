"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of ``2**slots`` entries serves all languages: entry s holds a mask
with bit l set if some n-gram of language l hashes there.  ANDing the entries
of an n-gram's hashes returns, in one look-up, every language that may contain
it.  A text's masks are counted per language; with n n-grams of which c hit
language l, whose filter answers falsely at rate f (its fill to the
power of the hashes), the corrected count is (c - n f) / (1 - f).  The largest
corrected share decides.

An n-gram belongs to a language if it holds at least ``share`` of that
language's n-grams and at least ``dominance`` of the highest such share over
all languages, so common n-grams of one language do not fill every filter.
Shares come from a sample of at most about ``per_lang`` documents of each
language, chosen by a hash of doc_id and text; languages are told by their own
``MASK_BITS`` bits, in as many 64-bit words as they need.  More than
``MOST_LANGS`` values of lang are refused, as the table grows with them.

Texts are lower-cased, letters and the marks that combine with them count, and
words are padded with spaces.  A text that is null or has no letter is ``und``
with score 0; so is every text if nothing can be learnt.  Languages of equal
score go by name, the smallest first.  Rows that repeat a doc_id are judged
one by one.  A null doc_id teaches nothing and counts as held out.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import bytesops as B
from fragmill.llm.ftrl import learnable
from fragmill.llm.runtime import cut, join_small, uniform

#: Lengths of n-grams, in characters of padded words.
LENGTHS = (2, 3, 4)
SLOTS, HASHES, MASK_BITS = 20, 3, 64
SHARE, DOMINANCE = 2e-5, 0.3
PER_LANG = 2_000
#: The table has a bit of ``2**SLOTS`` entries for each language: 128 MB at this many.
MOST_LANGS = 1_024

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_SALT = np.random.default_rng(20101).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def letters(text: str | None) -> str:
    """Lower-case words of letters with one space before, between and after; empty without letters."""
    line = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {line} " if any(c.isalpha() for c in line) else ""


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word with a space at both ends, and the word of each."""
    padded = [f" {w} " for w in words]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(B.U64)
    row = np.repeat(np.arange(len(words)), np.array([len(x) for x in padded], np.int64))
    keys, rows = [np.zeros(0, B.U64)], [np.zeros(0, np.int64)]
    for n in LENGTHS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, B.U64)
        for k in range(n):
            h = (h + codes[k : k + m]) * _SALT[k]
        ok = row[:m] == row[n - 1 :]
        keys.append(B.mix64(h[ok] + B.U64(n)))
        rows.append(row[:m][ok])
    return np.concatenate(keys), np.concatenate(rows)


def slots(key: np.ndarray, bits: int = SLOTS) -> list[np.ndarray]:
    """The entries of each n-gram, one array for each hash."""
    return [(B.mix64(key * _SALT[k + 4]) >> B.U64(64 - bits)).astype(np.int64) for k in range(HASHES)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram and how often it occurs in this batch."""
    for batch in batches:
        words: dict[str, Counter[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(letters(text).split())
        for lang, counts in words.items():
            found, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            for k in range(0, len(found), 50_000):
                own, row = grams(found[k : k + 50_000])
                key, inverse = np.unique(own, return_inverse=True)
                n = np.bincount(inverse, times[k : k + 50_000][row], len(key))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def own_grams(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], DataFrame]:
    """Languages in order, and lang and gram of the n-grams that belong to each."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable("doc_id", 3, 1)).select("doc_id", "text", "lang")
    sizes = cut(usable.groupBy("lang").agg(F.count("*").alias("docs")))
    langs = [r.lang for r in sizes.select("lang").orderBy("lang").limit(MOST_LANGS + 1).collect()]
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    chance = uniform(F.lit("langid"), "doc_id", "text")
    sample = join_small(usable, sizes, "lang", spread=F.xxhash64("doc_id")).where(chance < per_lang / F.col("docs"))
    counts = cut(sample.select("text", "lang").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(total), "lang").where(F.col("n") >= SHARE * F.col("total")).select("gram", "lang", (F.col("n") / F.col("total")).alias("share"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    return sorted(langs), shares.join(best, "gram").where(F.col("share") >= DOMINANCE * F.col("best")).select("lang", "gram")


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages in order and the bit-sliced table, entries x words of mask."""
    langs, grams = own_grams(docs, per_lang)
    table = np.zeros((1 << SLOTS, max(1, -(-len(langs) // MASK_BITS))), B.U64)
    number = {lang: k for k, lang in enumerate(langs)}
    # At most 1 / SHARE n-grams of a language pass, so this is bounded by the number of languages.
    for lang, rows in grams.toPandas().groupby("lang"):
        k = number[lang]
        for at in slots(rows["gram"].to_numpy(np.int64).view(B.U64)):
            table[at, k // MASK_BITS] |= B.U64(1) << B.U64(k % MASK_BITS)
    return langs, table


def judge(lines: list[str], langs: list[str], table: np.ndarray, false: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the language of each line (-1: none) and the score.

    n-grams lie inside words, so each distinct word is looked up once and counts as often as it occurs.
    """
    ids: dict[str, int] = {}
    own, counts = [], np.zeros(len(lines), np.int64)
    for k, line in enumerate(lines):
        words = line.split()
        counts[k] = len(words)
        own += [ids.setdefault(w, len(ids)) for w in words]
    at, row = np.array(own, np.int64), np.repeat(np.arange(len(lines)), counts)
    key, word = grams(list(ids))
    masks = np.full((len(key), table.shape[1]), ~B.U64(0))
    for place in slots(key):
        masks &= table[place]
    n = np.bincount(row, np.bincount(word, minlength=len(ids))[at], len(lines))
    shares = np.zeros((len(lines), len(langs)))
    for k in range(len(langs)):
        hit = (masks[:, k // MASK_BITS] >> B.U64(k % MASK_BITS)) & B.U64(1) == 1
        c = np.bincount(row, np.bincount(word[hit], minlength=len(ids))[at], len(lines))
        shares[:, k] = np.clip((c - n * false[k]) / (1 - false[k]) / np.maximum(n, 1), 0, 1)
    best = shares.argmax(axis=1)
    return np.where(n > 0, best, -1), np.where(n > 0, shares.max(axis=1), 0.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` (with a text column) and columns lang_pred and score; columns of those names are replaced."""
    langs, table = model
    held = docs.sparkSession.sparkContext.broadcast((langs, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = held.value
        ones = [(table[:, k // MASK_BITS] >> B.U64(k % MASK_BITS)) & B.U64(1) for k in range(len(langs))]
        false = np.array([float(x.mean()) ** HASHES for x in ones])
        names = np.array([*langs, "und"], object)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, score = np.full(len(texts), -1), np.zeros(len(texts))
            at = 0
            while at < len(texts) and langs:
                to, size = at, 0
                while to < len(texts) and size < 4 * B.SLICE:
                    size += len(texts[to] or "")
                    to += 1
                pred[at:to], score[at:to] = judge([letters(x) for x in texts[at:to]], langs, table, false)
                at = to
            out = {"lang_pred": pa.array(names[pred], pa.string()), "score": pa.array(score)}
            yield pa.RecordBatch.from_arrays([out.get(c, x) for c, x in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    wide = docs.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    return wide.mapInArrow(run, wide.schema)


def op10(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (~learnable("doc_id", 3, 1)).alias("held_out"), "lang_pred", "score")
