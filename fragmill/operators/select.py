"""Narrowing and ranking: only, degree, top, boosted top, rank with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.model import Context
from fragmill.operators.frag import Frag
from fragmill.session import cut

BOOST, KIND_PREFERENCE = 0.6, 0.3


def _one_of(column: str, values: str | Sequence[str] | None) -> Column | None:
    """A condition, or None for no condition; an empty list lets nothing pass."""
    if values is None:
        return None
    values = [values] if isinstance(values, str) else list(values)
    return F.col(column).isin(values) if values else F.lit(False)


def only(frag: Frag, *, kind: str | Sequence[str] | None = None, file: str | Sequence[str] | None = None, language: str | Sequence[str] | None = None, where: Column | None = None) -> Frag:
    """Nodes that meet every condition given; ``where`` is a column expression over the nodes."""
    nodes = frag.nodes
    for condition in (_one_of("kind", kind), _one_of("file", file), _one_of("language", language), where):
        if condition is not None:
            nodes = nodes.where(condition)
    return frag.induced(nodes.select("symbol_id"))


def degrees(edges: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """symbol_id, n_in and n_out; parallel edges count each. An empty list of kinds counts nothing."""
    chosen = edges if kinds is None else edges.where(_one_of("kind", list(kinds)))
    ends = chosen.select(F.explode(F.array(F.struct(F.col("src").alias("symbol_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("symbol_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.symbol_id").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def degree(frag: Frag, ctx: Context, *, edge: str | Sequence[str] | None = "calls", min_in: int | None = None, max_in: int | None = None, min_out: int | None = None, max_out: int | None = None) -> Frag:
    """Nodes whose degrees in the whole graph lie within the bounds, both ends included."""
    if all(x is None for x in (min_in, max_in, min_out, max_out)):
        return frag
    kinds = [edge] if isinstance(edge, str) else edge
    bounds = (("n_in", "dst", min_in, max_in), ("n_out", "src", min_out, max_out))
    if any(low is not None and low > 0 for _, _, low, _ in bounds) and all(high is None or high >= 0 for _, _, _, high in bounds):
        # What no edge touches is below a bound, so each side is counted alone and no node meets the counts before they are cut.
        chosen = ctx.edge_table if kinds is None else ctx.edge_table.where(_one_of("kind", list(kinds)))
        out = frag
        for _, end, low, high in sorted(bounds, key=lambda b: -(b[2] or 0)):
            counts = chosen.groupBy(F.col(end).alias("symbol_id")).agg(F.count("*").alias("n"))
            if low is not None and low > 0:
                out = out.induced(counts.where((F.col("n") >= low) & (F.lit(True) if high is None else F.col("n") <= high)).select("symbol_id"))
            elif high is not None:
                out = out._trimmed(out.nodes.join(counts.where(F.col("n") > high).select("symbol_id"), "symbol_id", "left_anti"))
        return out
    found = frag.nodes.select("symbol_id").join(degrees(ctx.edge_table, kinds), "symbol_id", "left").fillna(0, ["n_in", "n_out"])
    for column, low, high in (("n_in", min_in, max_in), ("n_out", min_out, max_out)):
        found = found.where(F.lit(True) if low is None else F.col(column) >= low).where(F.lit(True) if high is None else F.col(column) <= high)
    return frag.induced(found.select("symbol_id"))


def top_ids(scores: DataFrame, n: int) -> DataFrame:
    """The n best of ``scores(symbol_id, score)``; ties go to the smaller id.

    Scores tie at nine places, as their last digits depend on the order of their products.
    """
    if n < 0:
        raise ValueError("a negative number of results")
    return scores.orderBy(F.desc(F.round("score", 9)), "symbol_id").limit(n)


def top(frag: Frag, n: int, *, by: str | None = None) -> Frag:
    return frag.induced(cut(top_ids(frag.score(by), n).select("symbol_id")))


def boosted_scores(frag: Frag, boosted: DataFrame | None = None, kinds: Sequence[str] = ()) -> DataFrame:
    """symbol_id and score, raised for neighbours of an answer and for preferred kinds."""
    scored = frag.score()
    near = F.lit(0.0)
    if boosted is not None:
        scored = scored.join(boosted.select("symbol_id", F.lit(1.0).alias("near")).distinct(), "symbol_id", "left")
        near = F.coalesce("near", F.lit(0.0))
    liked = F.lit(0.0)
    if kinds:
        scored = scored.join(frag.nodes.select("symbol_id", "kind"), "symbol_id")
        liked = F.when(F.col("kind").isin(list(kinds)), 1.0).otherwise(0.0)
    return scored.select("symbol_id", (F.col("score") * (1 + BOOST * near) * (1 + KIND_PREFERENCE * liked)).alias("score"))


def ranked(frag: Frag, limit: int, scores: DataFrame | None = None) -> DataFrame:
    """rank, symbol_id, name, kind, file and score of the best, by raw score unless told otherwise."""
    best = top_ids(frag.score() if scores is None else scores, limit)
    order = Window.orderBy(F.desc(F.round("score", 9)), "symbol_id")
    rows = best.withColumn("rank", F.row_number().over(order))
    return rows.join(frag.nodes.select("symbol_id", "name", "kind", "file"), "symbol_id").select("rank", "symbol_id", "name", "kind", "file", F.round("score", 4).alias("score"))


def reasons(frag: Frag) -> DataFrame:
    """symbol_id and why: the three strongest raw hits as detail@field, and the first verdict."""
    order = Window.partitionBy("symbol_id").orderBy(F.desc(F.round("score", 9)), "detail", "field")
    hits = frag.hits.where("signal <> 'combined'").withColumn("n", F.row_number().over(order)).where("n <= 3").select("symbol_id", "n", F.concat("detail", F.lit("@"), "field").alias("text"))
    first = Window.partitionBy("symbol_id").orderBy("source", "label", "reason")
    verdicts = frag.verdicts.withColumn("n", F.row_number().over(first)).where("n = 1").select("symbol_id", F.lit(4).alias("n"), F.concat("label", F.lit(":"), "reason").alias("text"))
    return hits.unionByName(verdicts).groupBy("symbol_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), ", ").alias("why"))
