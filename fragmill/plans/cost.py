"""Estimates of rows and cost from index statistics; one small job for all units of a query."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.model import Context
from fragmill.operators.select import degrees
from fragmill.operators.units import QueryUnit, surfaces

# Fixed values of the cost model.
INTENT_COST, INTENT_PASS, FALLBACK_DEGREE, DEGREE_SAMPLE, EDGE_SAMPLE = 5000.0, 0.5, 4.0, 200, 300


@dataclass(frozen=True)
class Estimate:
    rows: int
    cost: float
    detail: str = ""


def estimates(units: Sequence[QueryUnit], ctx: Context) -> DataFrame:
    """unit, rows and cost: the union of its terms' postings under independence, and their lengths."""
    looked = F.broadcast(surfaces(units, ctx).select("unit", "surface"))
    words = [r.surface for r in looked.select("surface").distinct().collect()]
    lengths = ctx.postings.where(F.col("term").isin(words)).groupBy("term").agg(F.count("*").alias("length"))
    stats = ctx.terms.where(F.col("term").isin(words)).select("term", "df").join(lengths, "term").join(looked, F.col("term") == F.col("surface"))
    n = float(max(ctx.total, 1))
    miss = F.product(1 - F.least(F.col("df") / n, F.lit(1.0)))
    return stats.groupBy("unit").agg(F.round(n * (1 - miss)).cast("long").alias("rows"), F.sum("length").alias("cost"))


def estimate_units(units: Sequence[QueryUnit], ctx: Context) -> dict[str, Estimate]:
    found = {r.unit: Estimate(r.rows, float(r.cost)) for r in estimates(units, ctx).collect()}
    return {u.name: found.get(u.name, Estimate(0, 0.0)) for u in units}


def average_degree_frame(ctx: Context, sample: int = DEGREE_SAMPLE) -> DataFrame:
    """The mean degree of the first ``sample`` symbols by id, 1 at least."""
    first = ctx.symbols.select("symbol_id").orderBy("symbol_id").limit(sample)
    own = degrees(ctx.edge_table.select("src", "dst", "kind"))
    n = first.join(own, "symbol_id", "left").select((F.coalesce("n_in", F.lit(0)) + F.coalesce("n_out", F.lit(0))).alias("n"))
    return n.agg(F.greatest(F.avg("n"), F.lit(1.0)).alias("average"))


def edge_estimate(ctx: Context, sample: int = EDGE_SAMPLE) -> DataFrame:
    """estimate: about how many edge ends the graph has, from the degrees of the first ``sample`` symbols by id; 0 without symbols."""
    first = ctx.symbols.select("symbol_id").orderBy("symbol_id").limit(sample)
    ends = first.join(degrees(ctx.edge_table.select("src", "dst", "kind")), "symbol_id", "left").select((F.coalesce("n_in", F.lit(0)) + F.coalesce("n_out", F.lit(0))).alias("n"))
    seen = ends.agg(F.sum("n").alias("seen"), F.count("*").alias("checked"))
    return seen.select(F.when(F.col("checked") > 0, F.floor(F.col("seen") * float(ctx.total) / F.col("checked"))).otherwise(0).cast("long").alias("estimate"))


def average_degree(ctx: Context) -> float:
    found = average_degree_frame(ctx).first()
    return found.average if found and found.average is not None else FALLBACK_DEGREE


def estimate_hop(src_rows: int, total: int, degree: float, hops: tuple[int, int], dst_rows: int | None = None) -> Estimate:
    """Rows reached by powers of the mean degree, all rows at most, then thinned by how dense the goal is."""
    reach, touched = float(src_rows), 0.0
    for _ in range(hops[1]):
        reach *= degree
        touched = min(touched + reach, float(total))
    density = 1.0 if dst_rows is None else min(dst_rows / max(total, 1), 1.0)
    return Estimate(min(total, round(touched * density)), touched, f"avg degree {degree:.1f}")


def estimate_intent(rows: int) -> Estimate:
    return Estimate(round(rows * INTENT_PASS), rows * INTENT_COST, "judge")
