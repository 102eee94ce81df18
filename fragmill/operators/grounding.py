"""Grounding: general vocabulary mapped to the corpus's own spellings, by rules and by vectors.

The theta self-join of a vocabulary is blocked: prefixes meet by their stem,
abbreviations by their skeleton, subsequences by first letter and length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.functions import text as T
from fragmill.model import ICF_FLOOR
from fragmill.session import maybe_broadcast, spread

RULES = ("prefix", "abbrev", "subseq")
# Scores of the rules, and the lengths they need.
PREFIX, ABBREV, SUBSEQ = 0.75, 0.75, 0.5
SHORTEST, LONGEST_SUBSEQ, LENGTH_RATIO, MAX_TARGETS = 3, 5, 3, 4
#: A word lists up to 1,470 subsequences, so the number of tasks follows the words and not the bytes.
WORDS_A_TASK = 5_000
COSINE_FLOOR, VECTOR_CEILING, VECTOR_LEAST = 0.55, 0.6, 0.05


def discriminating(terms: DataFrame, total: int, floor: float = ICF_FLOOR) -> DataFrame:
    """Terms of df 2 or more and two letters or more that are rare enough; none in a corpus of one."""
    if total <= 1:
        return terms.limit(0)
    return terms.where((F.col("df") >= 2) & (F.length("term") >= 2) & (F.col("df") <= total) & (F.col("icf_ratio") >= floor))


def lexical_pairs(words: DataFrame, targets: DataFrame, reasons: Sequence[str] = RULES) -> DataFrame:
    """key (long), target (short), score and reason by the first rule that holds, of ``words(word)`` and ``targets(term)``; of these ``reasons`` alone, if given.

    A pair itself tells whether an earlier rule holds for it, so the rules list
    disjoint pairs, and none is joined for the sake of another.
    """
    short = targets.select(F.col("term").alias("target")).where(F.length("target") >= SHORTEST).distinct()
    long = words.select(F.col("word").alias("key")).distinct()
    longer, other = F.length("key") > F.length("target"), ~F.startswith("key", "target")

    def prefix() -> DataFrame:
        """Each word knows its own stems, so prefixes meet in an equi-join."""
        stems = long.select("key", F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.length("key")), lambda n: F.substr("key", F.lit(1), n))).alias("stem")).where((F.length("key") > F.length("stem")) & (F.length("key") > SHORTEST))
        # Spark takes an explode's rows for as few as the words before it, so by estimate it would broadcast the exploded side through the driver.
        return stems.hint("merge").join(short, F.col("stem") == F.col("target"))

    def abbrev() -> DataFrame:
        bones = short.select("target", T.skeleton("target").alias("bone"))
        return long.select("key", T.skeleton("key").alias("b")).hint("merge").join(bones, F.col("b") == F.col("bone")).where(longer & other)

    def subseq() -> DataFrame:
        """Long words of at most 15 letters list their own subsequences with the same first letter, so these meet in an equi-join too."""
        small = short.where(F.length("target") <= LONGEST_SUBSEQ).select("target", T.skeleton("target").alias("bone"))
        dealt = spread(long, long.count() // WORDS_A_TASK, "key")
        inner = dealt.where(F.length("key") <= LENGTH_RATIO * LONGEST_SUBSEQ).select("key", F.explode(short_subsequences("key")).alias("target"))
        return inner.hint("merge").join(maybe_broadcast(small), "target").where(other & (T.skeleton("key") != F.col("bone")))

    rules = {"prefix": (prefix, PREFIX), "abbrev": (abbrev, ABBREV), "subseq": (subseq, SUBSEQ)}
    pairs = [f().select("key", "target", F.lit(score).alias("score"), F.lit(reason).alias("reason")) for reason, (f, score) in rules.items() if reason in reasons]
    return reduce(DataFrame.unionByName, pairs)


def short_subsequences(word: str) -> Column:
    """The distinct subsequences of 3 to 5 letters that keep the first letter and that the word is longer than, but at most three times as long."""
    letters, n = F.split(F.col(word), ""), F.length(word)
    # Letter by letter, so that only what a word has is listed and no list of 16,384 masks is filtered for it.
    grown = lambda found, c: F.array_distinct(F.concat(found, F.transform(F.filter(found, lambda x: F.length(x) < LONGEST_SUBSEQ), lambda x: F.concat(x, c))))
    found = F.aggregate(F.slice(letters, 2, F.greatest(n - 1, F.lit(0))), F.slice(letters, 1, 1), grown)
    return F.filter(found, lambda x: F.length(x).between(SHORTEST, LONGEST_SUBSEQ) & (F.length(x) < n) & (n <= LENGTH_RATIO * F.length(x)))


def top_targets(pairs: DataFrame, k: int = MAX_TARGETS) -> DataFrame:
    """The k best targets of each key, in order (ord from 1); ties go by name."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "target")
    return pairs.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= k)


def vector_score(cosine: Column) -> Column:
    """0 up to the floor, then linear to the ceiling; what is too small is null."""
    scaled = F.round(VECTOR_CEILING * F.greatest(F.least((cosine - COSINE_FLOOR) / (1 - COSINE_FLOOR), F.lit(1.0)), F.lit(0.0)), 4)
    return F.when(scaled >= VECTOR_LEAST, scaled)


def _best(cosine: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row, ties at nine places by name; only what may be among them is sorted."""
    n = cosine.shape[1]
    if n > k:
        known = np.where(np.isnan(cosine), -np.inf, cosine) if np.isnan(cosine).any() else cosine
        least = np.partition(known, n - k, axis=1)[:, n - k] - 2e-9
        row, column = np.nonzero(known >= least[:, None])
    else:
        row, column = np.divmod(np.arange(cosine.size), n)
    order = np.lexsort((names[column], -np.round(cosine[row, column], 9), row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def cosine_top(queries: DataFrame, targets: DataFrame, k: int, *, block: int = 4096, probes: int = 8192) -> DataFrame:
    """id, target_id, cosine and ord: the k nearest of ``targets(id, v)`` to each of ``queries(id, v)``, exactly.

    Blocks of about ``block`` targets meet parts of about ``probes`` queries in
    executors; each pair of a block and a part gives every query its best k
    there, and these meet in a grouped top k.  No vector comes to the driver.
    Vectors of either side that repeat an id count one by one.
    """
    blocks, parts = max(1, -(-targets.count() // block)), max(1, -(-queries.count() // probes))
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = F.col("v").cast("array<double>").alias("v")
    held = targets.select(place("target", blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("side"), "id", v)
    asked = queries.select(every(blocks).alias("block"), place("query", parts).alias("part"), F.lit(1).alias("side"), "id", v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, part and side: a pair's targets first."""
        key, ids, rows, matrix = None, [], [], np.zeros((0, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "part", "side")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                piece = batch.slice(i, j - i)
                own = piece.column("id").to_numpy()
                x = piece.column("v").flatten().to_numpy().reshape(j - i, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                if tuple(keys[i, :2]) != key:
                    key, ids, rows, matrix = tuple(keys[i, :2]), [], [], np.zeros((0, x.shape[1]))
                if keys[i, 2] == 0:
                    ids.append(own)
                    rows.append(x)
                    continue
                if rows:
                    matrix, rows = np.concatenate(rows), []
                    names = np.concatenate(ids)
                if not len(matrix):
                    continue
                for at in range(0, len(x), 1024):
                    cosine = x[at : at + 1024] @ matrix.T
                    row, column = _best(cosine, names, k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[at : at + 1024][row]), pa.array(names[column]), pa.array(cosine[row, column])], names=["id", "target_id", "cosine"])

    out = held.unionByName(asked).repartition("block", "part").sortWithinPartitions("block", "part", "side").mapInArrow(run, "id long, target_id long, cosine double")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "target_id")
    return out.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= k)


def merged(lexical: DataFrame, vectors: DataFrame, k: int = MAX_TARGETS) -> DataFrame:
    """Both tables (key, target, score, reason) as one: the higher score, the lexical reason where there is one."""
    both = lexical.select("key", "target", F.col("score").alias("ls"), F.col("reason").alias("lr")).join(vectors.select("key", "target", F.col("score").alias("vs"), F.col("reason").alias("vr")), ["key", "target"], "full")
    return top_targets(both.select("key", "target", F.greatest("ls", "vs").alias("score"), F.coalesce("lr", "vr").alias("reason")), k)


def meta_closure(direct: DataFrame, depth: int = 3, decay: float = 0.8) -> DataFrame:
    """General to specific annotations from ``direct(specific, general)``: 1.0, then less by ``decay`` a step, at most ``depth``."""
    now = direct.distinct().select(F.col("general").alias("key"), F.col("specific").alias("target"), F.lit(1.0).alias("score"))
    out, step = now, direct.distinct()
    for _ in range(depth - 1):
        now = now.join(step, now.target == step.general).select("key", F.col("specific").alias("target"), (F.col("score") * decay).alias("score"))
        out = out.unionByName(now)
    return out.where("key <> target").groupBy("key", "target").agg(F.round(F.max("score"), 6).alias("score")).withColumn("reason", F.lit("meta"))


def coverage(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """reached, words and share of the vocabulary that some key reaches."""
    words = vocabulary.select("term").distinct()
    reached = pairs.select(F.col("target").alias("term"), F.lit(1).alias("hit")).distinct()
    counts = words.join(reached, "term", "left").agg(F.count("hit").alias("reached"), F.count("*").alias("words"))
    return counts.select("reached", "words", F.round(F.col("reached") / F.greatest("words", F.lit(1)), 6).alias("share"))
