"""Structured conditions over symbols: types, paths, keywords, exact matches, set expressions, tiers and ladders."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.functions.text import fuzzy_match

#: Filters of symbols by name, for plans that name them.
FILTERS: dict[str, Callable[..., DataFrame]] = {}


def symbol_filter(name: str):
    """Registers a filter (symbols, options) -> symbols under a name that is free."""

    def register(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in FILTERS:
            raise ValueError(f"filter {name!r} exists")
        FILTERS[name] = run
        return run

    return register


def filtered(symbols: DataFrame, name: str, **options: object) -> DataFrame:
    """``symbols`` through the filter of this name."""
    if name not in FILTERS:
        raise KeyError(f"no filter {name!r}; there are {sorted(FILTERS)}")
    return FILTERS[name](symbols, **options)


@symbol_filter("types")
def of_types(symbols: DataFrame, types: Sequence[str] | None, column: str = "kind") -> DataFrame:
    """Symbols of these types, whatever their case; none, ``any`` and ``null`` are no condition."""
    wanted = [t.lower() for t in types or [] if t]
    return symbols if not wanted or {"any", "null"} & set(wanted) else symbols.where(F.lower(column).isin(wanted))


def path_matches(path: Column, wanted: str, suffix: bool = False) -> Column:
    """Whether a path ends with ``wanted``, or else has it as a run of whole directories; dots of a package are slashes."""
    if suffix:
        return path.endswith(wanted)
    return F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit("/" + wanted.replace(".", "/").strip("/") + "/"))


def looks_like_file(wanted: str, extensions: Sequence[str] = (".java", ".py", ".js", ".ts", ".c", ".h", ".cpp")) -> bool:
    return wanted.endswith(tuple(extensions))


@symbol_filter("path")
def in_path(symbols: DataFrame, wanted: str) -> DataFrame:
    """Symbols of a file or directory: ``wanted`` is a file by its extension, or if the path of some symbol ends in it."""
    path = F.concat(F.lit("/"), F.col("file"))
    ends = F.endswith(path, F.lit("/" + wanted.strip("/")))
    if looks_like_file(wanted) or not symbols.where(ends).isEmpty():
        return symbols.where(ends)
    return symbols.where(path_matches(F.col("file"), wanted))


@symbol_filter("keyword")
def keyword_search(symbols: DataFrame, keywords: Sequence[tuple[str, bool, bool]], every: bool = False, column: str = "name") -> DataFrame:
    """Symbols whose name has any (or every) keyword: (text, as a whole word, with its case)."""
    conditions = []
    for text, whole, cased in keywords:
        name = F.col(column) if cased else F.lower(column)
        text = text if cased else text.lower()
        escaped = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)
        conditions.append(name.rlike(rf"\b{escaped}\b") if whole else F.contains(name, F.lit(text)))
    out = F.lit(every)
    for c in conditions:
        out = (out & c) if every else (out | c)
    return symbols.where(out)


def exact_search(symbols: DataFrame, text: str, limit: int, column: str = "name") -> DataFrame:
    """symbol_id and score: 1 for an equal name, 0.8 for one that has the text, neither case nor underscores counting."""
    plain = text.lower().replace("_", "")
    name = F.replace(F.lower(column), F.lit("_"), F.lit(""))
    hits = symbols.where(F.contains(name, F.lit(plain)))
    return hits.select("symbol_id", F.when(name == plain, 1.0).otherwise(0.8).alias("score")).orderBy(F.desc("score"), "symbol_id").limit(limit)


# The kinds that an element stands for, and what its matches score.
ELEMENT_KINDS = {
    "function": ("function", "method"),
    "method": ("method",),
    "class": ("class",),
    "variable": ("variable", "field", "parameter", "constant"),
    "unknown": ("function", "method", "class", "variable", "field", "parameter", "constant"),
}
FIELD_SCORES = {"name": 1.5, "signature": 1.35, "file": 1.45}
EXACT_BONUS, NAMED_KIND_BONUS, LINE_BASE, EXACT_LINE = 0.3, 0.2, 1.0, 1.6


def exact_elements(symbols: DataFrame, items: Sequence[tuple[str, str, bool]], top: int | None = 50) -> DataFrame:
    """symbol_id, query, field and score of symbols that are the code a query names: items of (text, element, exact).

    A file matches by the last components of its path; other elements by name,
    else by signature, if their kind is the element's: equal but for case and
    underscores if exact, else by similarity.  An unknown element matches nothing.
    """
    asked = [F.struct(F.lit(t).alias("query"), F.lit(e).alias("element"), F.lit(x).alias("exact"), F.lit(list(ELEMENT_KINDS.get(e, ()))).cast("array<string>").alias("kinds")) for t, e, x in items]
    rows = symbols.select("symbol_id", "name", "signature", "file", F.lower("kind").alias("kind"), F.explode(F.array(*asked)).alias("q"))
    rows = rows.where((F.col("q.element") == "file") | F.array_contains("q.kinds", F.col("kind")))
    parts = lambda c: F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    wanted = parts(F.col("q.query"))
    in_file = (F.col("q.element") == "file") & (F.size(wanted) > 0) & (F.slice(parts(F.col("file")), -F.greatest(F.size(wanted), F.lit(1)), F.greatest(F.size(wanted), F.lit(1))) == wanted)
    plain = lambda c: F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(""))
    vague = F.when((F.col("q.element") != "file") & ~F.col("q.exact"), F.col("q.query"))
    named = lambda c: (F.col("q.element") != "file") & (F.trim(F.col(c)) != "") & F.when(F.col("q.exact"), plain(F.col("q.query")) == plain(F.col(c))).otherwise(fuzzy_match(vague, F.col(c)) > 0)
    field = F.when(in_file, "file").when(named("name"), "name").when(named("signature"), "signature")
    found = rows.withColumn("field", field).where("field IS NOT NULL")
    score = F.create_map(*[F.lit(x) for pair in FIELD_SCORES.items() for x in pair])[F.col("field")]
    score += F.when(F.col("q.exact"), EXACT_BONUS).otherwise(0.0)
    score += F.when((F.col("field") == "name") & F.col("q.element").isin("function", "method", "class", "variable"), NAMED_KIND_BONUS).otherwise(0.0)
    out = found.select("symbol_id", F.col("q.query").alias("query"), "field", F.round(score, 4).alias("score")).distinct()
    return out if top is None else out.orderBy(F.desc("score"), "symbol_id", "query", "field").limit(top)


def source_lines(files: DataFrame) -> DataFrame:
    """file, line (from 1) and text of ``files(file, text)``."""
    return files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def exact_lines(symbols: DataFrame, lines: DataFrame, items: Sequence[tuple[str, bool]], top: int | None = 50) -> DataFrame:
    """symbol_id, query, line and score of the best line in each symbol's span that is, or with exact off is like, a query line: items of (text, exact).

    Lines are matched before they meet the spans of their file.
    """
    squeezed = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    asked = F.array(*[F.struct(F.lit(t).alias("query"), F.lit(x).alias("exact")) for t, x in items])
    rows = lines.where(F.trim("text") != "").select("file", "line", "text", F.explode(asked).alias("q"))
    score = F.when(F.col("q.exact"), F.when(squeezed(F.col("q.query")) == squeezed(F.col("text")), EXACT_LINE).otherwise(0.0)).otherwise(fuzzy_match(F.when(~F.col("q.exact"), F.col("q.query")), F.trim("text")))
    hits = rows.withColumn("score", score).where("score > 0")
    spans = symbols.where("span.start > 0 AND span.end > 0").select("symbol_id", F.col("file").alias("of"), "span")
    met = hits.join(spans, (F.col("file") == F.col("of")) & F.col("line").between(F.col("span.start"), F.col("span.end")))
    best = met.groupBy("symbol_id", F.col("q.query").alias("query")).agg(F.max(F.struct("score", (-F.col("line")).alias("back"))).alias("m"))
    out = best.select("symbol_id", "query", (-F.col("m.back")).alias("line"), F.round(F.col("m.score") + LINE_BASE, 4).alias("score"))
    return out if top is None else out.orderBy(F.desc("score"), "symbol_id", "query").limit(top)


def meaningful(word: Column, stop: Sequence[str], keep: Sequence[str] = ()) -> Column:
    """Words worth indexing: kept ones first, then no stop words, numbers or single letters."""
    return word.isin(list(keep)) | (~word.isin(list(stop)) & (F.length(word) > 1) & ~word.rlike("^[0-9]+$"))


def _ids(df: DataFrame) -> DataFrame:
    return df.select("symbol_id")


def condition_expression(conditions: Sequence[tuple[str, Sequence[str], DataFrame]], excluded: Sequence[DataFrame] = ()) -> DataFrame:
    """Symbols of a set expression over (kind, types, symbols): equal kinds and types intersect, others unite, exclusions go last."""
    groups: dict[tuple, DataFrame] = {}
    for kind, types, rows in conditions:
        key = (kind, tuple(sorted(types)))
        groups[key] = groups[key].join(_ids(rows), "symbol_id", "left_semi") if key in groups else _ids(rows).distinct()
    out = None
    for rows in groups.values():
        out = rows if out is None else out.unionByName(rows)
    out = out.distinct()
    for rows in excluded:
        out = out.join(_ids(rows), "symbol_id", "left_anti")
    return out


def relation_plan(candidates: DataFrame, include: Sequence[DataFrame | None], exclude: Sequence[DataFrame | None]) -> DataFrame:
    """Candidates in every include clause and in no exclude clause; a clause that nothing could execute (None) changes nothing."""
    out = candidates
    for rows in include:
        out = out if rows is None else out.join(_ids(rows), "symbol_id", "left_semi")
    for rows in exclude:
        out = out if rows is None else out.join(_ids(rows), "symbol_id", "left_anti")
    return out


def and_hop(groups: Sequence[DataFrame], edges: DataFrame | None, rules: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Symbols of groups tied by rules (group, group, hops): ends of pairs within the hops; groups without a rule are intersected.

    Without rules or a call graph this is the plain intersection; a rule that
    no pair meets leaves nothing.
    """
    from fragmill.operators.graph import pairs_within

    def intersection(rows: Sequence[DataFrame]) -> DataFrame:
        out = _ids(rows[0]).distinct()
        for more in rows[1:]:
            out = out.join(_ids(more), "symbol_id", "left_semi")
        return out

    if not rules or edges is None:
        return intersection(groups)
    out = None
    for i, j, hops in rules:
        pairs = pairs_within(groups[i], groups[j], edges, hops)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("symbol_id")).distinct()
        if ends.isEmpty():
            return ends
        out = ends if out is None else out.unionByName(ends).distinct()
    rest = [g for k, g in enumerate(groups) if not any(k in r[:2] for r in rules)]
    return out.join(intersection(rest), "symbol_id", "left_semi") if rest else out


def clause(groups: Sequence[DataFrame], *, include: bool = True, edges: DataFrame | None = None, rules: Sequence[tuple[int, int, int]] = ()) -> DataFrame | None:
    """Symbols of keyword groups: one group as it is; several tied by rules (include) or united (exclude); none gives None."""
    if not groups:
        return None
    if len(groups) == 1:
        return _ids(groups[0]).distinct()
    if include:
        return and_hop(groups, edges, rules)
    out = _ids(groups[0])
    for more in groups[1:]:
        out = out.unionByName(_ids(more))
    return out.distinct()


def condition(include: DataFrame | None, exclude: DataFrame | None) -> tuple[str, DataFrame | None]:
    """What a condition does and its symbols: identity, subtract, exclude_only (the excluded ones, to take away later) or empty."""
    if include is not None and exclude is not None:
        return "subtract", _ids(include).join(_ids(exclude), "symbol_id", "left_anti")
    if include is not None:
        return "identity", _ids(include)
    return ("empty", None) if exclude is None else ("exclude_only", _ids(exclude))


def decision(include: Column, exclude: Column) -> Column:
    """Strong exclusion discards, strong inclusion without it keeps, weak inclusion discards; the rest is gray."""
    return F.when(exclude >= 0.6, "discard").when((include >= 0.55) & (exclude < 0.35), "keep").when(include < 0.2, "discard").otherwise("gray")


def adaptive_decision(scored: DataFrame) -> DataFrame:
    """``scored(symbol_id, include, exclude)`` with decisions; gray ones split at their 40% and 80% quantiles where these differ."""
    rows = scored.withColumn("decision", decision(F.col("include"), F.col("exclude")))
    cuts = rows.where("decision = 'gray'").agg(F.percentile("include", F.lit(0.4)).alias("low"), F.percentile("include", F.lit(0.8)).alias("high")).first()
    if cuts is None or cuts.low is None or cuts.high - cuts.low < 1e-9:
        return rows
    gray = F.when(F.col("include") >= cuts.high, "keep").when(F.col("include") < cuts.low, "discard").otherwise("gray")
    return rows.withColumn("decision", F.when(F.col("decision") == "gray", gray).otherwise(F.col("decision")))


def penalised(similarity: Column, a: Column, b: Column, cutoff: float) -> Column:
    """Similarity of two terms, lowered by their mean icf over the cutoff where both are common."""
    return F.when((a <= cutoff) & (b <= cutoff), similarity * F.least((a + b) / 2 / cutoff, F.lit(1.0))).otherwise(similarity)


def hybrid(together: Column, meaning: Column) -> Column:
    """Two fifths of the co-occurrence and three fifths of the semantic score, negatives counting as nothing."""
    return 0.4 * F.greatest(together, F.lit(0.0)) + 0.6 * F.greatest(meaning, F.lit(0.0))


def reranked(first: Column, cross: Column) -> Column:
    """A pairwise reranker's mix with what ranked first."""
    return 0.4 * first + 0.6 * cross


def keyword_score(base: Column, frequency: Column, rank: Column, words: Column, sources: Column) -> Column:
    """A keyword's score by its base, frequency and rank (0 to 1), with bonuses for length and for several sources."""
    score = 0.45 * base + 0.30 * frequency + 0.20 * rank + F.when(words > 1, 0.05).otherwise(0.0)
    return F.least(F.when(sources >= 2, score * 1.05).otherwise(score), F.lit(1.0))


def include_exclude(rows: DataFrame) -> DataFrame:
    """candidate, include (mean over query terms of the best score) and exclude (best of all) of ``rows(candidate, term, score)``."""
    best = rows.groupBy("candidate", "term").agg(F.max("score").alias("best"))
    return best.groupBy("candidate").agg(F.avg("best").alias("include"), F.max("best").alias("exclude"))


def tiers(scored: DataFrame, first: float = 0.1, second: float = 0.2) -> DataFrame:
    """``scored(symbol_id, score)`` with tiers 1, 2 and 3: a tenth (one at least), a fifth, the rest.

    The cuts are order statistics found by top-k, so no window spans all rows.
    """
    n = scored.count()
    one = max(math.ceil(first * n), 1)
    two = one + math.ceil(second * n)

    def last(k: int) -> Column:
        row = scored.orderBy(F.desc("score"), "symbol_id").limit(k).agg(F.max(F.struct((-F.col("score")).alias("s"), "symbol_id")).alias("m")).first()["m"]
        return F.lit(False) if row is None else F.struct((-F.col("score")).alias("s"), F.col("symbol_id").cast("long").alias("i")) <= F.struct(F.lit(row["s"]).alias("s"), F.lit(row["symbol_id"]).cast("long").alias("i"))

    return scored.withColumn("tier", F.when(last(one), 1).when(last(min(two, max(n, 1))), 2).otherwise(3))


def adaptive_k(share: Column) -> Column:
    """How many neighbours a term gets by its share of chains; an unknown term gets ten."""
    return F.when(share.isNull(), 10).when(share >= 0.5, 3).when(share >= 0.25, 5).when(share >= 0.1, 8).otherwise(10)


def cluster_average(vectors: np.ndarray, threshold: float = 0.3) -> np.ndarray:
    """Average-linkage clusters of a few hundred candidates by cosine distance, as numbers from 0."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    distance = 1 - v @ v.T
    np.fill_diagonal(distance, np.inf)
    members = {k: [k] for k in range(len(v))}
    while len(members) > 1:
        a, b = np.unravel_index(np.argmin(distance), distance.shape)
        if distance[a, b] > threshold:
            break
        na, nb = len(members[a]), len(members[b])
        joined = (distance[a] * na + distance[b] * nb) / (na + nb)
        distance[a], distance[:, a] = joined, joined
        distance[a, a] = np.inf
        distance[b], distance[:, b] = np.inf, np.inf
        members[a] += members.pop(b)
    out = np.zeros(len(v), int)
    for n, group in enumerate(sorted(members.values(), key=min)):
        out[group] = n
    return out


def kept_clusters(scores: Sequence[float], share: float = 0.6, spread: float = 0.05) -> list[bool]:
    """Which clusters stay by their scores: the best three fifths, or all if they are few or alike."""
    n = len(scores)
    if n < 3 or max(scores) - min(scores) < spread:
        return [True] * n
    order = sorted(range(n), key=lambda k: (-scores[k], k))[: math.ceil(share * n)]
    return [k in order for k in range(n)]


def cluster_tiers(rows: DataFrame, *, share: float = 0.6, first: float = 0.1, second: float = 0.2, least: int = 3, spread: float = 0.05, defer: bool = False) -> DataFrame:
    """``rows(symbol_id, cluster, cluster_score, score)`` with tier (1 to 4), outcome and tier_rank.

    Clusters go by score: a tenth (one at least) is tier 1, a fifth tier 2, the
    rest of the best three fifths tier 3; others are tier 4, discarded, or with
    ``defer`` left for a rescue by their own scores.  Fewer than ``least``
    clusters, or scores within ``spread``, keep all.  The windows span one row
    for each cluster, and a tier of the few candidates that are clustered.
    """
    clusters = rows.groupBy("cluster").agg(F.max("cluster_score").alias("top"))
    every = Window.partitionBy(F.lit(0))
    n = F.count("*").over(every)
    near = (n < least) | (F.max("top").over(every) - F.min("top").over(every) < spread)
    placed = clusters.select("cluster", F.row_number().over(every.orderBy(F.desc("top"), "cluster")).alias("place"), n.alias("n"), near.alias("near"))
    kept = F.when(F.col("near"), F.col("n")).otherwise(F.greatest(F.ceil(F.col("n") * share), F.lit(1)))
    one = F.least(kept, F.greatest(F.ceil(F.col("n") * first), F.lit(1)))
    two = one + F.least(kept - one, F.ceil(F.col("n") * second))
    tier = F.when(F.col("place") <= one, 1).when(F.col("place") <= two, 2).when(F.col("place") <= kept, 3).otherwise(4)
    out = rows.join(placed.select("cluster", tier.alias("tier")), "cluster")
    outcome = F.when(F.col("tier") < 4, "kept").otherwise("rescue" if defer else "discarded")
    order = Window.partitionBy("tier").orderBy(F.desc("cluster_score"), F.desc("score"), "symbol_id")
    return out.withColumn("outcome", outcome).withColumn("tier_rank", F.row_number().over(order)).select("symbol_id", "cluster", "tier", "outcome", "tier_rank")


def first_wins(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of symbols where the left record of an id stays."""
    both = left.withColumn("__s", F.lit(0)).unionByName(right.withColumn("__s", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(Window.partitionBy("symbol_id").orderBy("__s"))).where("__n = 1").drop("__n", "__s")
