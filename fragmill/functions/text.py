"""Text functions: words, identifier pieces, abbreviation rules, segmentation, similarity."""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the index: words kept of a doc, lengths and margins of segmentation.
DOC_WORDS = 40
MIN_COMPOUND, MIN_PIECE, SPLIT_MARGIN, UNKNOWN_COST = 6, 2, 1.0, 30.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_of(text: Column | str, limit: int | None = None) -> Column:
    """Lower-case runs of two ASCII letters or more, in order, the first ``limit`` of them."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0))
    return F.transform(found if limit is None else F.slice(found, 1, limit), F.lower)


def split_identifier(name: Column | str) -> Column:
    """Lower-case pieces of an identifier at non-letters and camel-case boundaries."""
    spaced = F.regexp_replace(F.coalesce(_col(name), F.lit("")), "[^A-Za-z]+", " ")
    spaced = F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), " +"), lambda x: x != "")


def argument_tokens(text: Column | str) -> Column:
    """Distinct lower-case tokens of an annotation's argument, without numbers."""
    tokens = F.split(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9_]+")
    return F.array_distinct(F.filter(tokens, lambda x: (x != "") & ~x.rlike("^[0-9]+$")))


def skeleton(word: Column | str) -> Column:
    """First letter and the consonants after it, adjacent repeats collapsed."""
    tail = F.regexp_replace(F.regexp_replace(F.substr(_col(word), F.lit(2)), "[aeiou]", ""), r"(.)\1+", "$1")
    return F.concat(F.substr(_col(word), F.lit(1), F.lit(1)), tail)


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the letters of ``short`` occur in ``long`` in order."""
    pattern = F.regexp_replace(short, "(.)", "$1.*")
    return F.rlike(long, F.concat(F.lit(".*"), pattern))


def abbreviation_agrees(full: Column, abbreviation: Column) -> Column:
    """Both or neither have digits, both or neither have letters, and their digits are equal."""
    digits = [F.regexp_replace(x, "[^0-9]", "") for x in (full, abbreviation)]
    letters = [F.regexp_replace(x, "[^A-Za-z]", "") for x in (full, abbreviation)]
    return (digits[0] == digits[1]) & ((letters[0] == "") == (letters[1] == ""))


def window_corpus(chain: Column) -> Column:
    """Sentences of a call chain: whole once, windows of 2 and 3 twice, edges three times."""
    n = F.size(chain)

    def runs(width: int) -> Column:
        return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda k: F.slice(chain, k, width))).otherwise(F.array().cast("array<array<string>>"))

    pairs, triples = runs(2), runs(3)
    return F.concat(F.array(chain), pairs, pairs, triples, triples, pairs, pairs, pairs)


#: Words of a phrase whose subsets are listed: 2**20 of them would be a mistake.
MOST_WORDS = 16


def ordered_subterms(words: Column) -> Column:
    """All non-empty subsets of the words, in order, joined by spaces; a phrase of more than ``MOST_WORDS`` words raises."""
    n = F.size(words)
    few = F.when(n <= MOST_WORDS, n).otherwise(F.raise_error(F.concat(F.lit("too many words for subsets: "), n.cast("string"))).cast("int"))
    masks = F.sequence(F.lit(1), F.greatest(F.pow(F.lit(2), few).cast("int") - 1, F.lit(1)))
    chosen = F.transform(masks, lambda m: F.array_join(F.filter(words, lambda w, i: F.getbit(m.cast("long"), i) == 1), " "))
    return F.array_distinct(F.filter(chosen, lambda x: x != ""))


CONDITIONS, WORDS = ("surface", "intention", "relation"), ("keywords", "synonyms", "term")


def condition_terms(payload: Column | str, sides: tuple[str, ...] = ("include",), kinds: tuple[str, ...] = CONDITIONS, fields: tuple[str, ...] = WORDS) -> Column:
    """Distinct trimmed strings that a structured query (JSON) names, in order.

    First those of its conditions by kind, side, place and field, then those of
    the fields at the top level.  A field is a string or a list of strings;
    what is blank or not there gives nothing, and so does a payload that is no
    object.
    """
    none = F.array().cast("array<string>")

    def values(raw: Column) -> Column:
        """Spark reads a field of either shape as text: a list keeps its brackets."""
        return F.when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), none)).when(raw.isNotNull(), F.array(raw)).otherwise(none)

    row = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
    side = "struct<" + ",".join(f"{s}:array<{row}>" for s in sides) + ">"
    parsed = F.from_json(_col(payload), "conditions struct<" + ",".join(f"{k}:{side}" for k in kinds) + ">," + ",".join(f"{f} string" for f in fields))
    rows = F.array().cast(f"array<{row}>")
    found = [F.flatten(F.transform(F.coalesce(parsed["conditions"][k][s], rows), lambda x: F.concat(*[values(x[f]) for f in fields]))) for k in kinds for s in sides]
    found += [values(parsed[f]) for f in fields]
    return F.array_distinct(F.filter(F.transform(F.concat(*found), lambda x: F.trim(x)), lambda x: x != ""))


def segment(token: str, cost: Mapping[str, float], longest: int) -> tuple[str, ...]:
    """Cheapest pieces of a compound under word costs, or none if it is better whole."""
    n = len(token)
    if n < MIN_COMPOUND or not token.isalpha() or not cost:
        return ()
    best: list[tuple[float, tuple[str, ...]] | None] = [(0.0, ())] + [None] * n
    for end in range(MIN_PIECE, n + 1):
        for start in range(end - MIN_PIECE, max(-1, end - longest - 1), -1):
            piece = token[start:end]
            if best[start] is not None and piece in cost:
                total = best[start][0] + cost[piece]
                if best[end] is None or total < best[end][0]:
                    best[end] = (total, (*best[start][1], piece))
    if best[n] is None or len(best[n][1]) < 2 or best[n][0] + SPLIT_MARGIN > cost.get(token, UNKNOWN_COST):
        return ()
    return best[n][1]


def segmented(terms: DataFrame, lexicon: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """term and pieces for each compound of ``terms(term)``; costs come from ``lexicon(term, n)``.

    The lexicon is a vocabulary, which grows far slower than its corpus; it is
    collected behind a check of its size.
    """
    words = lexicon.where((F.length("term") >= MIN_PIECE) & F.col("term").rlike("^[A-Za-z]+$") & (F.col("n") > 0))
    if words.count() > limit:
        raise ValueError(f"a lexicon of more than {limit} words")
    counts = {r.term: r.n for r in words.collect()}
    scale = math.log(sum(counts.values()) or 1)
    held = terms.sparkSession.sparkContext.broadcast({w: scale - math.log(n) for w, n in counts.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = held.value
        longest = max(map(len, cost), default=0)
        for batch in batches:
            found = [(t, list(p)) for t in batch.column("term").to_pylist() if t and (p := segment(t, cost, longest))]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.list_(pa.string()))], names=["term", "pieces"])

    return terms.select("term").mapInArrow(run, "term string, pieces array<string>")


def token_distance(a: str, b: str) -> float:
    """Edit distance of tokens over the longer length; a change costs 0 if equal, .1 by case, .4 within a prefix, else 1."""
    x, y = re.findall(r"[A-Za-z0-9]+", a), re.findall(r"[A-Za-z0-9]+", b)
    if not x or not y:
        return 1.0
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            change = 0.0 if p == q else 0.1 if p.lower() == q.lower() else 0.4 if p.lower().startswith(q.lower()) or q.lower().startswith(p.lower()) else 1.0
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + change)
    return row[-1] / max(len(x), len(y))


def fuzzy_score(a: str | None, b: str | None) -> float:
    """1 if equal, .98 if equal but for case; else token similarity if token counts and sets are near, or 0."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a.casefold() == b.casefold():
        return 0.98
    x, y = ({t.lower() for t in re.findall(r"[A-Za-z0-9]+", s)} for s in (a, b))
    if not x or not y or abs(len(x) - len(y)) / max(len(x), len(y)) > 0.4 or len(x & y) / len(x | y) < 0.5:
        return 0.0
    score = 1.0 - token_distance(a, b)
    return score if score >= 0.65 else 0.0


def fuzzy_match(a: Column, b: Column) -> Column:
    """``fuzzy_score`` over Arrow batches; filter by cheap columns first."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([fuzzy_score(p, q) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(run, "double")(a, b)


def abbreviations(phrase: str, most: int = 5_000) -> list[str]:
    """Candidate short forms of a phrase, by a count cap: prefixes, consonant runs, initials and their joins."""
    words = [w for w in re.split(r"[^a-z0-9]+", phrase.lower()) if w]
    per = []
    for w in words:
        bones = w[:1] + re.sub(r"(.)\1+", r"\1", re.sub("[aeiou]", "", w[1:]))
        per.append(list(dict.fromkeys([*(w[:k] for k in range(1, len(w) + 1)), *(bones[:k] for k in range(2, len(bones) + 1)), w[0] + str(len(w) - 2) + w[-1] if len(w) > 3 else w])))
    joined = ("".join(parts) for parts in itertools.product(*per)) if per else ()
    initials = ["".join(w[0] for w in words)] if len(words) > 1 else []
    return list(dict.fromkeys(itertools.islice(itertools.chain(initials, joined), most)))


def json_in(text: str) -> object | None:
    """The first JSON value inside free text or a code fence, or None."""
    text = re.sub(r"```(?:json)?", "", text or "")
    for opening, closing in (("[", "]"), ("{", "}")):
        a, b = text.find(opening), text.rfind(closing)
        if 0 <= a < b:
            try:
                return json.loads(text[a : b + 1])
            except ValueError:
                continue
    return None
