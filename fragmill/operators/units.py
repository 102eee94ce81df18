"""Query units: terms, satisfiers, and their evaluation over the index in one pass for all units."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.model import Context, field_weight
from fragmill.operators.combine import COMBINERS, combine
from fragmill.session import maybe_broadcast


@dataclass(frozen=True)
class Term:
    value: str
    source: str = "literal"
    weight: float = 1.0
    reason: str = ""

    def __post_init__(self) -> None:
        if not self.value:
            raise ValueError("an empty term")
        if self.source not in ("literal", "synonym", "derived"):
            raise ValueError(f"unknown source {self.source!r}")


def as_terms(values: Sequence[str | Term]) -> tuple[Term, ...]:
    return tuple(v if isinstance(v, Term) else Term(v) for v in values)


@dataclass(frozen=True)
class Lexical:
    terms: Sequence[str | Term]
    weight: float = 0.5
    fields: Sequence[str] | None = None
    signal = "lexical"

    def probes(self) -> list[tuple[Term, list[str] | None]]:
        return [(t, None if self.fields is None else list(self.fields)) for t in as_terms(self.terms)]


@dataclass(frozen=True)
class Annotation:
    names: Sequence[str | Term] = ()
    terms: Sequence[str | Term] = ()
    weight: float = 0.9
    signal = "annotation"

    def probes(self) -> list[tuple[Term, list[str] | None]]:
        return [(t, ["annotation", "annotation_arg"]) for t in as_terms((*self.terms, *self.names))]


@dataclass(frozen=True)
class Modifier:
    modifiers: Sequence[str | Term]
    weight: float = 0.6
    signal = "modifier"

    def probes(self) -> list[tuple[Term, list[str] | None]]:
        return [(Term(t.value.lower(), t.source, t.weight, t.reason), ["modifier"]) for t in as_terms(self.modifiers)]


#: Satisfiers that turn terms into probes of the postings; another kind is a class with ``weight``, ``signal`` and ``probes``.
SATISFIERS: dict[str, Callable] = {"lexical": Lexical, "annotation": Annotation, "modifier": Modifier}


@dataclass(frozen=True)
class QueryUnit:
    name: str
    satisfiers: Sequence[object] = field(default_factory=tuple)
    combine: str = "noisy_or"
    concept: str = ""

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a unit without a name")
        if self.combine not in COMBINERS:
            raise KeyError(f"no combiner {self.combine!r}; there are {sorted(COMBINERS)}")
        for s in self.satisfiers:
            if not hasattr(s, "probes"):
                raise TypeError(f"{type(s).__name__} is no satisfier")


#: Surfaces of a query whose terms are pushed into the scan; beyond them the join alone selects.
MOST_SURFACES = 10_000

_PROBES = "unit string, satisfier int, signal string, weight double, term string, term_weight double, fields array<string>"


def surfaces(units: Sequence[QueryUnit], ctx: Context) -> DataFrame:
    """Probes and the surfaces they look up: themselves at 1.0 first, then their expansions.

    As many rows as the query has terms and expansions of them: bounded by the
    query, so it may be broadcast.
    """
    rows = [(u.name, k, s.signal, float(s.weight), t.value, float(t.weight), f) for u in units for k, s in enumerate(u.satisfiers) for t, f in s.probes()]
    probes = ctx.spark.createDataFrame(rows, _PROBES)
    exact = probes.select("*", F.col("term").alias("surface"), F.lit(1.0).alias("surface_score"), F.lit("exact").alias("reason"))
    if ctx.expansion is None:
        return exact
    wanted = sorted({r[4] for r in rows})
    more = ctx.expansion.where(F.col("key").isin(wanted)).select("key", F.col("target").alias("surface"), F.col("score").alias("surface_score"), "reason")
    return exact.unionByName(probes.join(more, probes.term == more.key).drop("key"))


def term_hits(units: Sequence[QueryUnit], ctx: Context) -> DataFrame:
    """All hits of all units: surfaces to statistics to postings, multiplied and floored.

    A surface the caller asked for is never dropped for being common; an
    expansion is, below the floor.  The query's surfaces come to the driver, so
    that an index in term buckets is read in theirs alone; they are broadcast
    if there are few, as there are but for closures of general words.
    """
    looked = surfaces(units, ctx)
    words = [r.surface for r in looked.select("surface").distinct().limit(MOST_SURFACES + 1).collect()]
    own = (lambda table: ctx.about(table, words)) if len(words) <= MOST_SURFACES else (lambda table: table)
    known = own(ctx.terms).select(F.col("term").alias("known"), "icf_ratio")
    stats = maybe_broadcast(known.join(maybe_broadcast(looked), F.col("known") == F.col("surface")).drop("known").where((F.col("reason") == "exact") | (F.col("icf_ratio") >= ctx.icf_floor)))
    posted = own(ctx.postings).select(F.col("term").alias("posted"), "symbol_id", "field")
    hits = posted.join(stats, F.col("posted") == F.col("surface"))
    hits = hits.where(F.col("fields").isNull() | F.array_contains("fields", F.col("field")))
    score = F.col("weight") * F.col("term_weight") * F.col("surface_score") * field_weight(F.col("field"), ctx.weights) * F.col("icf_ratio")
    detail = F.when(F.col("reason") == "exact", F.col("term")).otherwise(F.concat("surface", F.lit("←"), "term", F.lit("("), "reason", F.lit(")")))
    hits = hits.select("symbol_id", "unit", "satisfier", "signal", detail.alias("detail"), "field", score.alias("score"))
    return hits.where(F.col("score") >= ctx.min_hit_score)


def unit_scores(hits: DataFrame, units: Sequence[QueryUnit]) -> DataFrame:
    """symbol_id, unit, score and signals: noisy-or within a satisfier, the unit's own rule across them."""
    within = hits.groupBy("unit", "symbol_id", "satisfier").agg(combine("noisy_or", F.col("score")).alias("score"))
    out = None
    for rule in sorted({u.combine for u in units}):
        own = within.where(F.col("unit").isin([u.name for u in units if u.combine == rule]))
        part = own.groupBy("unit", "symbol_id").agg(combine(rule, F.col("score")).alias("score"), F.count("*").alias("signals"), F.lit(rule).alias("rule"))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(units: Sequence[QueryUnit], ctx: Context) -> DataFrame:
    """Evidence rows of the units: their hits, and a combined hit for each symbol and unit.

    Symbols that the store does not hold vanish.
    """
    hits = term_hits(units, ctx).join(ctx.symbols.select("symbol_id"), "symbol_id", "left_semi")
    total = unit_scores(hits, units)
    combined = total.select("symbol_id", "unit", F.lit(-1).alias("satisfier"), F.lit("combined").alias("signal"), F.format_string("%s(%d signals)", "rule", "signals").alias("detail"), F.lit("").alias("field"), "score")
    return hits.unionByName(combined)
