"""From understood words to a specification: groups and relations are proposed, then checked by statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from fragmill.model import Context
from fragmill.operators import measures as M
from fragmill.operators.frag import eval_unit
from fragmill.operators.units import Annotation, Lexical, QueryUnit
from fragmill.plans.spec import GraphConstraint, QuerySpec


def known_terms(terms: Sequence[str], ctx: Context) -> list[str]:
    """Terms of the vocabulary or with an expansion, first seen first."""
    words = list(dict.fromkeys(t.lower() for t in terms))
    found = {r.term for r in ctx.terms.where(F.col("term").isin(words)).select("term").collect()}
    if ctx.expansion is not None:
        found |= {r.key for r in ctx.expansion.where(F.col("key").isin(words)).select("key").distinct().collect()}
    return [w for w in words if w in found]


def build_spec(query: str, terms: Sequence[str], ctx: Context, *, concept: str = "", annotations: Sequence[str] = (), groups: Sequence[Sequence[str]] = (), relations: Sequence[tuple[int, int]] = (), limit: int | None = None) -> tuple[QuerySpec, list[str]]:
    """The specification and notes on what was not believed."""
    words, notes = known_terms(terms, ctx), []
    if not words and not annotations:
        raise ValueError("no word of the query is in the vocabulary")
    believed = []
    for g in groups:
        own = [w for w in known_terms(g, ctx) if w in words]
        if len(own) > 1 and M.cohesion(ctx, own) >= M.COHERENT:
            believed.append(own)
        else:
            notes.append(f"group {list(g)} does not cohere")
    parts = believed if len(believed) > 1 else M.partition(ctx, words) if words else []
    units = [QueryUnit(f"u{k}", (Lexical(p),)) for k, p in enumerate(parts)]
    if annotations:
        units.append(QueryUnit("annotations", (Annotation(list(annotations)),)))
    graph = []
    for i, j in relations if parts is believed else ():
        if max(i, j) < len(units) and ctx.edges is not None:
            a, b = (eval_unit(units[k], ctx).nodes for k in (i, j))
            if (M.lift(ctx, a, b).first().lift or 0.0) >= M.MIN_LIFT:
                graph.append(GraphConstraint(units[i].name, units[j].name))
            else:
                notes.append(f"relation {i}-{j} is no commoner than chance")
    kinds = tuple(r.kind for r in M.kind_shares(ctx, words).collect()) if words else ()
    return QuerySpec(tuple(units), tuple(graph), concept, kinds, limit), notes
