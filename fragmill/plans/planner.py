"""Plans: units ordered by selectivity, then boosts, coherence, narrowing and the judge; and their runs.

Units are united, never intersected; graph constraints and kinds weigh, they
do not filter.  Evaluating all units costs one pass over the postings.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.model import Context
from fragmill.operators import graph as G
from fragmill.operators import select as S
from fragmill.operators.frag import Frag
from fragmill.operators.intent import intent
from fragmill.operators.units import QueryUnit, evaluate
from fragmill.plans.cost import Estimate, average_degree, estimate_hop, estimate_intent, estimate_units
from fragmill.plans.spec import QuerySpec
from fragmill.session import cut

# Fixed values of the planner.
USELESS, JUDGE_CAP, ASYMMETRY, LEAST_WEIGHT, DEFAULT_LIMIT, SEEDS = 0.9, 60, 3, 0.15, 100, 20
GRAPH_EDGES, GRAPH_HOPS = ("calls", "contains"), (1, 2)


@dataclass
class State:
    units: dict[str, Frag] = field(default_factory=dict)
    current: Frag | None = None
    boosted: DataFrame | None = None
    trace: list[tuple[str, int, int, float]] = field(default_factory=list)

    def boost(self, near: DataFrame) -> None:
        rows = near.select("symbol_id").join(self.current.nodes.select("symbol_id"), "symbol_id", "left_semi")
        self.boosted = rows if self.boosted is None else self.boosted.unionByName(rows).distinct()


@dataclass(frozen=True)
class EvalUnit:
    unit: QueryUnit
    seed: bool

    @property
    def label(self) -> str:
        return f"unit({self.unit.name})" + ("  <- seed" if self.seed else "")


@dataclass(frozen=True)
class Filter:
    unit: str

    @property
    def label(self) -> str:
        return f"& {self.unit}"


@dataclass(frozen=True)
class Boost:
    src: str
    dst: str
    edge: tuple[str, ...] = GRAPH_EDGES
    hops: tuple[int, int] = GRAPH_HOPS

    @property
    def label(self) -> str:
        return f"boost({self.src} <-> {self.dst}, {self.hops[0]}-{self.hops[1]} hops)"


@dataclass(frozen=True)
class Cohere:
    seeds: int = SEEDS
    edge: tuple[str, ...] = GRAPH_EDGES
    hops: tuple[int, int] = GRAPH_HOPS

    @property
    def label(self) -> str:
        return f"cohere(top {self.seeds} as seeds, {self.hops[0]}-{self.hops[1]} hops)"


@dataclass(frozen=True)
class Narrow:
    kinds: tuple[str, ...] = ()
    limit: int | None = None

    @property
    def label(self) -> str:
        return "narrow(" + ", ".join([*([f"prefer {'/'.join(self.kinds[:3])}"] if self.kinds else []), *([f"top {self.limit}"] if self.limit else [])]) + ")"


@dataclass(frozen=True)
class Intent:
    concept: str
    most: int = JUDGE_CAP

    @property
    def label(self) -> str:
        return f'intent("{self.concept[:28]}")'


Step = EvalUnit | Filter | Boost | Cohere | Narrow | Intent


def _hits_of(step: Step, state: State, ctx: Context) -> None:
    if isinstance(step, EvalUnit):
        found = state.units[step.unit.name]
        state.current = found if step.seed else state.current | found
    elif isinstance(step, Filter):
        state.current = state.current & state.units[step.unit]
    elif isinstance(step, Boost):
        state.boost(G.reach(state.units[step.src], ctx, edge=step.edge, direction="any", hops=step.hops).nodes)
    elif isinstance(step, Cohere):
        state.boost(G.reach(S.top(state.current, step.seeds), ctx, edge=step.edge, direction="any", hops=step.hops).nodes)
    elif isinstance(step, Narrow):
        if step.limit:
            scores = S.boosted_scores(state.current, state.boosted, step.kinds)
            state.current = state.current.induced(S.top_ids(scores, step.limit).select("symbol_id"))
    else:
        state.current = intent(state.current, step.concept, ctx, max_items=step.most)


@dataclass(frozen=True)
class Plan:
    steps: tuple[Step, ...]
    reasoning: tuple[str, ...]
    estimates: tuple[Estimate, ...] = ()

    def run(self, ctx: Context, *, skip: Sequence[str] = (), measure: bool = False) -> State:
        """Runs the steps; with ``measure`` each is counted, else all but a judge stays lazy."""
        units = [s.unit for s in self.steps if isinstance(s, EvalUnit)]
        hits = cut(evaluate(units, ctx))
        state = State()
        for u in units:
            own = hits.where(F.col("unit") == u.name)
            state.units[u.name] = Frag.of(ctx.symbols.join(own.select("symbol_id").distinct(), "symbol_id", "left_semi"), hits=own)
        for k, step in enumerate(self.steps):
            if type(step).__name__.lower() in skip:
                continue
            began = time.monotonic()
            _hits_of(step, state, ctx)
            if measure:
                rows = len(state.current)
                state.trace.append((step.label, self.estimates[k].rows if k < len(self.estimates) else -1, rows, time.monotonic() - began))
                if not rows:
                    break
        return state

    def explain(self) -> str:
        lines = [f"{k + 1}. {s.label}" + (f"  ~{e.rows} rows, cost {e.cost:,.0f}" if e else "") for k, (s, e) in enumerate(zip(self.steps, [*self.estimates, *[None] * len(self.steps)], strict=False))]
        return "\n".join([*lines, *(f"- {w}" for w in self.reasoning)])


def reweighted(unit: QueryUnit, factor: float) -> QueryUnit:
    return replace(unit, satisfiers=tuple(replace(s, weight=s.weight * factor) for s in unit.satisfiers))


def plan(spec: QuerySpec, ctx: Context) -> Plan:
    total = max(ctx.total, 1)
    guess = estimate_units(spec.units, ctx)
    ordered = sorted(spec.units, key=lambda u: guess[u.name].rows)
    kept = [u for u in ordered if 0 < guess[u.name].rows <= USELESS * total]
    why = [f"{u.name} is left out: about {guess[u.name].rows} of {total} rows" for u in ordered if u not in kept]
    if not kept:
        kept = ordered[:1]
        why.append("no unit is selective; the narrowest stays")
    rows = {u.name: guess[u.name].rows for u in kept}
    steps: list[Step] = []
    sizes: list[Estimate] = []
    held = 0.0
    for k, u in enumerate(kept):
        factor = max(LEAST_WEIGHT, 1 - rows[u.name] / total)
        steps.append(EvalUnit(reweighted(u, factor), k == 0))
        held = rows[u.name] if k == 0 else total * (1 - (1 - held / total) * (1 - rows[u.name] / total))
        sizes.append(Estimate(round(held), guess[u.name].cost))
        why.append(f"{u.name}: about {rows[u.name]} rows, weight x{factor:.2f}")
    degree = average_degree(ctx) if ctx.edges is not None else 1.0
    for c in spec.graph:
        if c.src not in rows or c.dst not in rows:
            why.append(f"no constraint {c.src}-{c.dst}: a unit of it is left out")
            continue
        src, dst = (c.dst, c.src) if rows[c.dst] * ASYMMETRY < rows[c.src] else (c.src, c.dst)
        if src != c.src:
            why.append(f"constraint turned: {src} is far smaller than {dst}")
        steps.append(Boost(src, dst, c.edge, c.hops))
        sizes.append(replace(estimate_hop(rows[src], total, degree, c.hops, rows[dst]), rows=round(held)))
    steps.append(Cohere())
    sizes.append(replace(estimate_hop(min(round(held), SEEDS), total, degree, GRAPH_HOPS), rows=round(held)))
    limit = JUDGE_CAP if spec.concept else spec.limit if spec.kinds else spec.limit or DEFAULT_LIMIT
    steps.append(Narrow(spec.kinds, limit))
    sizes.append(Estimate(min(round(held), limit) if limit else round(held), held))
    if spec.concept:
        steps.append(Intent(spec.concept))
        sizes.append(estimate_intent(sizes[-1].rows))
        why.append("the judge comes last, on a capped input")
    return Plan(tuple(steps), tuple(why), tuple(sizes))
