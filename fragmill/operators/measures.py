"""Measures over an index: shares, cohesion, lift, partitions of terms, recall, means of vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.model import Context
from fragmill.session import maybe_broadcast

# Shares worth naming, and the bounds of a term partition.
KIND_SHARE, FIELD_SHARE = 0.25, 0.15
COHERENT, HUB_SHARE, MIN_LIFT = 0.08, 0.25, 1.2


def _shares(rows: DataFrame, key: str, least: float) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select(key, share.alias("share"), "n").where(F.col("share") >= least).orderBy(F.desc("share"), key).select(key, "share")


def kind_shares(ctx: Context, terms: Sequence[str], least: float = KIND_SHARE) -> DataFrame:
    """Kinds and their shares of the terms' postings, from ``least`` up."""
    rows = ctx.postings.where(F.col("term").isin(list(terms))).join(ctx.symbols.select("symbol_id", "kind"), "symbol_id")
    return _shares(rows, "kind", least)


def field_shares(ctx: Context, terms: Sequence[str], least: float = FIELD_SHARE) -> DataFrame:
    return _shares(ctx.postings.where(F.col("term").isin(list(terms))), "field", least)


def jaccards(ctx: Context, terms: Sequence[str]) -> DataFrame:
    """a, b and the Jaccard similarity of the posting sets of every two of a query's terms.

    Symbols carry their few terms as one array, so pairs form inside a row: as
    many rows as symbols, never a self-join of posting lists.
    """
    own = ctx.postings.where(F.col("term").isin(list(terms))).select("term", "symbol_id").distinct()
    sets = own.groupBy("symbol_id").agg(F.array_sort(F.collect_list("term")).alias("ts"))
    both = sets.select(F.explode("ts").alias("a"), "ts").select("a", F.explode("ts").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    sizes = own.groupBy("term").agg(F.count("*").alias("m"))
    known = sorted(r.term for r in sizes.select("term").collect())
    pairs = ctx.spark.createDataFrame([(a, b) for a in known for b in known if a < b], "a string, b string")
    out = pairs.join(both, ["a", "b"], "left").join(sizes.toDF("a", "ma"), "a").join(sizes.toDF("b", "mb"), "b")
    n = F.coalesce("n", F.lit(0))
    return out.select("a", "b", (n / (F.col("ma") + F.col("mb") - n)).alias("jaccard"))


def cohesion(ctx: Context, terms: Sequence[str]) -> float:
    """Mean pairwise Jaccard similarity; 0 for fewer than two terms."""
    return jaccards(ctx, terms).agg(F.avg("jaccard")).first()[0] or 0.0


def partition(ctx: Context, terms: Sequence[str]) -> list[list[str]]:
    """The terms in two or three coherent groups, or in one.

    Components at a Jaccard similarity of ``COHERENT``; terms on more than a
    quarter of all symbols are hubs and join nothing.  Only groups of two or
    more count; what is in none of them goes to the largest.  The number of
    terms is a query's, so this ends on the driver.
    """
    words = list(dict.fromkeys(terms))
    df = {r.term: r.df for r in ctx.terms.where(F.col("term").isin(words)).select("term", "df").collect()}
    hubs = {t for t in words if df.get(t, 0) > HUB_SHARE * ctx.total}
    group = {t: {t} for t in words if t not in hubs}
    for r in jaccards(ctx, [t for t in words if t not in hubs]).where(F.col("jaccard") >= COHERENT).collect():
        if group[r.a] is not group[r.b]:
            group[r.a] |= group[r.b]
            for t in group[r.b]:
                group[t] = group[r.a]
    found = sorted({id(g): g for g in group.values() if len(g) > 1}.values(), key=lambda g: (-len(g), min(words.index(t) for t in g)))
    if not 2 <= len(found) <= 3:
        return [words]
    stray = set(words).difference(*found)
    return [[t for t in words if t in g or (k == 0 and t in stray)] for k, g in enumerate(found)]


def lift(ctx: Context, a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges between two sets over what sets of their sizes would have by chance."""
    own = lambda x: x.select("symbol_id").distinct()
    e = ctx.edge_table.select("src", "dst")
    cross = e.join(own(a), F.col("src") == F.col("symbol_id"), "left_semi").join(own(b), F.col("dst") == F.col("symbol_id"), "left_semi")
    back = e.join(own(a), F.col("dst") == F.col("symbol_id"), "left_semi").join(own(b), F.col("src") == F.col("symbol_id"), "left_semi").select(F.col("dst"), F.col("src"))
    crossing = cross.union(back).distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(crossing, "x").select(F.struct(F.lit("x").alias("k"), F.col("x").alias("v")).alias("c"))
    for name, df in (("a", own(a)), ("b", own(b)), ("e", e)):
        counts = counts.union(n(df, "v").select(F.struct(F.lit(name).alias("k"), "v")))
    m = counts.agg(F.map_from_entries(F.collect_list("c")).alias("m"))
    chance = F.col("m")["a"] * F.col("m")["b"] * 2.0 * F.col("m")["e"] / float(ctx.total) ** 2
    return m.select(F.when(chance > 0, F.col("m")["x"] / chance).otherwise(0.0).alias("lift"))


def recall_at(ranking: DataFrame, gold: DataFrame, ks: Sequence[int]) -> DataFrame:
    """k and recall of ``gold(name)`` in ``ranking(name, symbol_id, score)``; a name counts at its best rank.

    Only the first max(ks) are ranked.
    """
    best = ranking.orderBy(F.desc(F.round("score", 9)), "symbol_id").limit(max(ks))
    order = Window.orderBy(F.desc(F.round("score", 9)), "symbol_id")
    ranks = best.withColumn("rank", F.row_number().over(order)).groupBy("name").agg(F.min("rank").alias("rank"))
    hits = gold.select("name").distinct().join(ranks, "name", "left").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"k{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("h")) for k in ks]))
    return hits.select("n", rows.alias("r")).select("r.k", F.when(F.col("n") > 0, F.col("r.h") / F.col("n")).otherwise(0.0).alias("recall"))


def chain_icf(stats: DataFrame, chains: int, share: float = 0.1) -> DataFrame:
    """term, icf and whether it is among the commonest tenth (one at least); the cut is an exact order statistic."""
    scored = stats.select("term", F.ln(F.lit(float(chains)) / F.col("df")).alias("icf"))
    most = max(math.ceil(share * scored.count()), 1)
    last = scored.orderBy("icf", "term").limit(most).agg(F.max(F.struct("icf", "term")).alias("m")).first()["m"]
    if last is None:
        return scored.withColumn("frequent", F.lit(False))
    return scored.withColumn("frequent", F.struct("icf", "term") <= F.struct(F.lit(last["icf"]), F.lit(last["term"])))


def mean_vectors(rows: DataFrame) -> DataFrame:
    """key and the mean of its vectors, of ``rows(key, v)``."""
    spread = rows.select("key", F.posexplode("v").alias("i", "x")).groupBy("key", "i").agg(F.avg("x").alias("m"))
    return spread.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))


def quantiles(rows: DataFrame, key: str, value: str, shares: Sequence[float]) -> DataFrame:
    """key and one column (q40 for 0.4) for each share: exact quantiles with linear interpolation."""
    return rows.groupBy(key).agg(*[F.percentile(value, F.lit(q)).alias(f"q{round(100 * q)}") for q in shares])


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of one length; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def co_occurrences(rows: DataFrame) -> DataFrame:
    """term, other and n: in how many entries of ``rows(symbol_id, term)`` two terms stand together.

    Entries are names, and so small arrays; pairs form inside a row.
    """
    sets = rows.groupBy("symbol_id").agg(F.collect_set("term").alias("ts"))
    return sets.select(F.explode("ts").alias("term"), "ts").select("term", F.explode("ts").alias("other")).where("term <> other").groupBy("term", "other").agg(F.count("*").alias("n"))


def mismatch(rows: DataFrame, stats: DataFrame, vectors: DataFrame, least: int = 3) -> DataFrame:
    """term, partners and agreement: how a term's vector agrees with its use in ``rows(symbol_id, term)``.

    The agreement is the mean cosine to the partners that have a vector,
    weighted by how often they stand together and by the partner's icf in
    ``stats(term, icf)``; fewer than ``least`` partners, or no weight, say nothing.
    """
    known = vectors.select("term", "v")
    pairs = co_occurrences(rows).join(known.toDF("other", "b"), "other").join(known.toDF("term", "a"), "term")
    pairs = pairs.join(stats.select(F.col("term").alias("other"), "icf"), "other", "left").withColumn("w", F.col("n") * F.coalesce("icf", F.lit(0.0)))
    own = pairs.groupBy("term").agg(F.count("*").alias("partners"), F.sum(F.col("w") * cosine(F.col("a"), F.col("b"))).alias("s"), F.sum("w").alias("w"))
    return own.where((F.col("partners") >= least) & (F.col("w") > 0)).select("term", "partners", (F.col("s") / F.col("w")).alias("agreement"))


def phrase_vectors(phrases: DataFrame, vectors: DataFrame) -> DataFrame:
    """id and v, the mean of the vectors of a phrase's words, of ``phrases(id, words)``; words without a vector do not count, phrases of none vanish."""
    words = phrases.select("id", F.explode("words").alias("term")).join(maybe_broadcast(vectors.select("term", "v")), "term")
    # A phrase is short, so its vectors stand in one row; no row is made for each of their numbers.
    held = words.groupBy("id").agg(F.collect_list("v").alias("vs")).where(F.size("vs") > 0)
    total = F.aggregate(F.slice("vs", 2, F.size("vs")), F.transform(F.element_at("vs", 1), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda p, q: p + q.cast("double")))
    return held.select("id", F.transform(total, lambda x: x / F.size("vs")).alias("v"))


def phrase_similarity(pairs: DataFrame, phrases: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs(a, b)`` of phrase ids with similarity: the cosine of their mean vectors, 0 at least, and 0 where one has none."""
    means = phrase_vectors(phrases, vectors)
    out = pairs.join(means.toDF("a", "va"), "a", "left").join(means.toDF("b", "vb"), "b", "left")
    return out.select("a", "b", F.greatest(F.coalesce(cosine(F.col("va"), F.col("vb")), F.lit(0.0)), F.lit(0.0)).alias("similarity"))


def semantic_neighbours(queries: DataFrame, vectors: DataFrame, excluded: DataFrame, k: int = 10) -> DataFrame:
    """id, term, score and ord: the k nearest terms of ``vectors(term, v)`` to each of ``queries(id, v)``, without its own ``excluded(id, term)``.

    As many more are looked for as a query excludes at most, so none is lost.
    """
    from fragmill.operators.grounding import cosine_top

    numbered = vectors.select("term", "v").withColumn("number", F.xxhash64("term"))
    most = excluded.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    near = cosine_top(queries.select("id", "v"), numbered.select(F.col("number").alias("id"), "v"), k + most).select("id", F.col("target_id").alias("number"), "cosine")
    named = near.join(numbered.select("number", "term"), "number").join(excluded.select("id", "term"), ["id", "term"], "left_anti")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "term")
    best = named.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= k)
    return best.select("id", "term", F.round(F.greatest("cosine", F.lit(0.0)), 6).alias("score"), "ord")
