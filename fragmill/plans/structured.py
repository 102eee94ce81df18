"""Plans of structured queries: surface conditions, relation clauses, and the stages that decide by intention."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.operators import structured as X

Keyword = tuple[str, bool, bool]


@dataclass(frozen=True)
class SurfaceCondition:
    """Symbols of these types whose names have the keywords of every include group and of no exclude group.

    Include groups are tied by rules (group, group, hops) over the call graph,
    if there are any.
    """

    types: tuple[str, ...] = ()
    include: tuple[tuple[Keyword, ...], ...] = ()
    exclude: tuple[tuple[Keyword, ...], ...] = ()
    rules: tuple[tuple[int, int, int], ...] = ()

    @classmethod
    def of(cls, payload: Mapping) -> SurfaceCondition:
        """From {types, include, exclude, rules}, where a keyword is a text or {text, whole, cased}; empty groups are left out."""

        def group(words: Sequence) -> tuple[Keyword, ...]:
            rows = [(w, False, False) if isinstance(w, str) else (w.get("text", ""), bool(w.get("whole")), bool(w.get("cased"))) for w in words]
            return tuple((t.strip(), whole, cased) for t, whole, cased in rows if t.strip())

        sides = [[g for g in map(group, payload.get(side, ())) if g] for side in ("include", "exclude")]
        rules = [tuple(map(int, r)) for r in payload.get("rules", ())]
        for a, b, hops in rules:
            if a == b or hops < 1 or not {a, b} <= set(range(len(sides[0]))):
                raise ValueError(f"a rule ties two include groups by one hop or more, not {(a, b, hops)}")
        return cls(tuple(payload.get("types", ())), tuple(sides[0]), tuple(sides[1]), tuple(rules))

    def run(self, symbols: DataFrame, edges: DataFrame | None = None) -> tuple[str, DataFrame | None]:
        own = X.of_types(symbols, self.types)
        found = [[X.keyword_search(own, g) for g in side] for side in (self.include, self.exclude)]
        return X.condition(X.clause(found[0], edges=edges, rules=self.rules), X.clause(found[1], include=False))


def surface(symbols: DataFrame, conditions: Sequence[SurfaceCondition], edges: DataFrame | None = None) -> DataFrame:
    """Symbols of a surface plan: conditions of equal types intersect, others unite; conditions that only exclude go last.

    Without a condition that includes, all symbols are what is taken from.
    """
    ran = [(c.types, *c.run(symbols, edges)) for c in conditions]
    wanted = [("types", types, rows) for types, how, rows in ran if how in ("identity", "subtract")]
    gone = [rows for _, how, rows in ran if how == "exclude_only"]
    return X.condition_expression(wanted or [("types", (), symbols)], gone)


@dataclass(frozen=True)
class RelationPlan:
    """Include and exclude clauses, each a list of (filter, options) that are applied in order."""

    include: tuple[tuple[tuple[str, dict], ...], ...] = ()
    exclude: tuple[tuple[tuple[str, dict], ...], ...] = ()

    def run(self, candidates: DataFrame) -> DataFrame:
        def rows(steps: Sequence[tuple[str, dict]]) -> DataFrame | None:
            out = candidates if steps else None
            for name, options in steps:
                out = X.filtered(out, name, **options)
            return out

        return X.relation_plan(candidates, [rows(c) for c in self.include], [rows(c) for c in self.exclude])


@dataclass(frozen=True)
class IntentionPlan:
    """Which stages decide, and what becomes of those between yes and no.

    Clusters are looked at from ``least`` candidates on.  ``gray`` is what a
    gray candidate gets without a judge, and where the judge fails or leaves it
    open: keep or drop.
    """

    cluster: bool = True
    embedding: bool = True
    least: int = 20
    gray: str = "keep"
    defer: bool = True
    tiers: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.gray not in ("keep", "drop"):
            raise ValueError(f"gray candidates are kept or dropped, not {self.gray!r}")


def intention(candidates: DataFrame, plan: IntentionPlan = IntentionPlan(), judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """symbol_id, stage and decision (keep or discard) of ``candidates(symbol_id, cluster, cluster_score, score, include, exclude)``.

    Weak clusters are discarded, or left for a rescue by the next stage; scores
    keep, discard or leave gray; the judge, a function from gray rows to
    (symbol_id, keep), decides the rest.
    """
    rows, out = candidates, []
    if plan.cluster and candidates.count() >= plan.least:
        tiers = X.cluster_tiers(candidates, defer=plan.defer and plan.embedding, **plan.tiers)
        gone = tiers.where("outcome = 'discarded'").select("symbol_id")
        out.append(gone.withColumns({"stage": F.lit("cluster"), "decision": F.lit("discard")}))
        rows = rows.join(gone, "symbol_id", "left_anti")
    told = X.adaptive_decision(rows) if plan.embedding else rows.withColumn("decision", F.lit("gray"))
    out.append(told.where("decision <> 'gray'").select("symbol_id", F.lit("embedding").alias("stage"), "decision"))
    gray = told.where("decision = 'gray'")
    left = F.lit(plan.gray == "keep")
    if judge is None:
        judged = gray.select("symbol_id", F.lit("left").alias("stage"), left.alias("keep"))
    else:
        judged = gray.select("symbol_id").join(judge(gray).select("symbol_id", F.col("keep").alias("said")), "symbol_id", "left").select("symbol_id", F.when(F.col("said").isNull(), "left").otherwise("judge").alias("stage"), F.coalesce("said", left).alias("keep"))
    out.append(judged.select("symbol_id", "stage", F.when(F.col("keep"), "keep").otherwise("discard").alias("decision")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
