"""Fragments: an annotated subgraph as lazy tables, and its algebra.

A fragment holds nodes (symbols), edges between them, evidence (hits and
verdicts) and witness paths.  Operators return new fragments; nothing runs
until rows are asked for.  Evidence never takes part in equality.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.model import EDGES, HITS, PATHS, VERDICTS, Context
from fragmill.operators.units import QueryUnit, evaluate
from fragmill.session import cut

EDGE_KEY = ["src", "dst", "kind"]


def _first(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row of each key, the first by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")


@dataclass(frozen=True, eq=False)
class Frag:
    nodes: DataFrame
    edges: DataFrame
    hits: DataFrame
    verdicts: DataFrame
    paths: DataFrame
    #: Tables known to be empty without a job; operators leave them alone.
    blank: frozenset[str] = frozenset()

    __hash__ = None

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame | None = None, hits: DataFrame | None = None, verdicts: DataFrame | None = None, paths: DataFrame | None = None) -> Frag:
        given = {"edges": (edges, EDGES), "hits": (hits, HITS), "verdicts": (verdicts, VERDICTS), "paths": (paths, PATHS)}
        tables = {k: df if df is not None else nodes.sparkSession.createDataFrame([], schema) for k, (df, schema) in given.items()}
        return cls(nodes, **tables, blank=frozenset(k for k, (df, _) in given.items() if df is None))

    def _trimmed(self, nodes: DataFrame) -> Frag:
        """Everything restricted to ``nodes``, rows of this fragment's own: edges with both ends, paths with all nodes.

        Only semi joins follow, so ids that repeat do no harm and are not sought.
        """
        keep = nodes.select("symbol_id")
        out = {"nodes": nodes}
        for name in {"hits", "verdicts"} - self.blank:
            out[name] = getattr(self, name).join(keep, "symbol_id", "left_semi")
        if "edges" not in self.blank:
            ends = keep.withColumnRenamed("symbol_id", "__id")
            out["edges"] = self.edges.join(ends, F.col("src") == F.col("__id"), "left_semi").join(ends, F.col("dst") == F.col("__id"), "left_semi")
        if "paths" not in self.blank:
            named = self.paths.withColumn("__p", F.xxhash64("nodes", "kinds"))
            lost = named.select("__p", F.explode("nodes").alias("symbol_id")).join(keep, "symbol_id", "left_anti").select("__p").distinct()
            out["paths"] = named.join(lost, "__p", "left_anti").drop("__p")
        return replace(self, **out)

    def induced(self, ids: DataFrame | Sequence[int]) -> Frag:
        """The subgraph of these symbols; ids it does not have are ignored."""
        if not isinstance(ids, DataFrame):
            ids = self.nodes.sparkSession.createDataFrame([(int(i),) for i in ids], "symbol_id long")
        return self._trimmed(self.nodes.join(ids.select("symbol_id"), "symbol_id", "left_semi"))

    def __or__(self, other: Frag) -> Frag:
        """Union; where both have a node or edge the right one's record stays."""

        def merged(name: str, key: list[str] | None = None) -> DataFrame:
            a, b = getattr(self, name), getattr(other, name)
            if name in self.blank or name in other.blank:
                return b if name in self.blank else a
            if key is None:
                return a.unionByName(b).distinct()
            return _first(a.withColumn("__s", F.lit(1)).unionByName(b.withColumn("__s", F.lit(0))), key, F.col("__s")).drop("__s")

        return Frag(merged("nodes", ["symbol_id"]), merged("edges", EDGE_KEY), merged("hits"), merged("verdicts"), merged("paths"), self.blank & other.blank)

    def __and__(self, other: Frag) -> Frag:
        """Nodes of both, with the edges and evidence of either."""
        ids = self.nodes.select("symbol_id").join(other.nodes.select("symbol_id"), "symbol_id", "left_semi")
        return (self | other).induced(ids)

    def __sub__(self, other: Frag) -> Frag:
        """Nodes of the left alone, with its evidence only."""
        return self._trimmed(self.nodes.join(other.nodes.select("symbol_id"), "symbol_id", "left_anti"))

    def roots(self) -> Frag:
        """Nodes that no edge of the fragment enters."""
        return self._trimmed(self.nodes.join(self.edges.select(F.col("dst").alias("symbol_id")), "symbol_id", "left_anti"))

    def leaves(self) -> Frag:
        """Nodes that no edge of the fragment leaves."""
        return self._trimmed(self.nodes.join(self.edges.select(F.col("src").alias("symbol_id")), "symbol_id", "left_anti"))

    def only_nodes(self) -> Frag:
        return replace(Frag.of(self.nodes), hits=self.hits, verdicts=self.verdicts, blank=self.blank | {"edges", "paths"})

    def same(self, other: Frag) -> bool:
        """Equal nodes and edges; evidence does not count.  Runs jobs."""
        pairs = [(self.nodes.select("symbol_id"), other.nodes.select("symbol_id")), (self.edges.select(EDGE_KEY), other.edges.select(EDGE_KEY))]
        return all(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in pairs)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Frag) and self.same(other)

    def __len__(self) -> int:
        return self.nodes.count()

    def __bool__(self) -> bool:
        return not self.nodes.isEmpty()

    def __contains__(self, symbol_id: int) -> bool:
        return not self.nodes.where(F.col("symbol_id") == symbol_id).isEmpty()

    def scores(self) -> DataFrame:
        """symbol_id, unit and score: the best combined hit of a unit, or else the sum of its raw hits."""
        done = F.max(F.when(F.col("signal") == "combined", F.col("score")))
        raw = F.sum(F.when(F.col("signal") != "combined", F.col("score")))
        return self.hits.groupBy("symbol_id", "unit").agg(F.coalesce(done, raw).alias("score"))

    def score(self, by: str | None = None) -> DataFrame:
        """symbol_id and score of every node, over all units or of one; 0 without evidence."""
        per = self.scores() if by is None else self.scores().where(F.col("unit") == by)
        total = per.groupBy("symbol_id").agg(F.sum("score").alias("score"))
        return self.nodes.select("symbol_id").join(total, "symbol_id", "left").select("symbol_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def eval_unit(unit: QueryUnit, ctx: Context, settle: bool = False) -> Frag:
    """Nodes that a unit matches, with their evidence and no edges.

    With ``settle`` the evidence is checkpointed, for what goes on to use it often.
    """
    hits = evaluate([unit], ctx)
    hits = cut(hits) if settle else hits
    return Frag.of(ctx.symbols.join(hits.select("symbol_id").distinct(), "symbol_id", "left_semi"), hits=hits)
