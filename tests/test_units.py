import math

import pytest

from fragmill.operators import combine as C
from fragmill.operators import select as S
from fragmill.operators.frag import Frag, eval_unit
from fragmill.operators.intent import Judge, intent
from fragmill.operators.units import Lexical, QueryUnit, Term, term_hits
from tests.helpers import corpus, graph, ids


def test_rare_words_score_higher(spark):
    ctx = corpus(spark, [("get", i, "name") for i in range(1, 208)] + [("login", 300, "name")], 1718)
    scores = {r.symbol_id: r.score for r in eval_unit(QueryUnit("q", (Lexical(["get", "login"]),)), ctx).score().collect()}
    assert len(scores) == 208
    assert scores[300] > scores[1]


def test_floor_holds_for_expansions_only(spark):
    posts = [("get", i, "name") for i in range(1, 208)]
    ctx = corpus(spark, posts, 1718, [("fetch", "get", 0.9, "prefix")])
    ctx.icf_floor = 0.5
    assert term_hits([QueryUnit("q", (Lexical(["fetch"]),))], ctx).count() == 0
    assert term_hits([QueryUnit("q", (Lexical(["get"]),))], ctx).count() == 207


def test_factors_multiply(spark):
    ctx = corpus(spark, [("buf", 1, "doc")], 100, [("buffer", "buf", 0.5, "prefix")])
    row = term_hits([QueryUnit("q", (Lexical([Term("buffer", weight=0.5)], weight=0.5),))], ctx).first()
    assert row.score == pytest.approx(0.5 * 0.5 * 0.5 * 0.3)
    assert row.detail == "buf←buffer(prefix)"


def test_combiners(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 1.5), ("c", -3.0)], "k string, s double")
    got = {r.k: r.v for r in df.groupBy("k").agg(C.combine("noisy_or", df.s).alias("v")).collect()}
    assert got == {"a": 0.75, "b": 1.0, "c": 0.0}
    assert df.limit(0).agg(C.combine("max", df.s).alias("v")).first().v == 0.0
    with pytest.raises(KeyError):
        C.combine("mean", df.s)
    with pytest.raises(ValueError):
        C.combiner("max")(lambda x: x)


def test_wrong_units_are_refused():
    with pytest.raises(ValueError):
        Term("")
    with pytest.raises(ValueError):
        QueryUnit("")
    with pytest.raises(TypeError):
        QueryUnit("q", ("words",))


def test_symbols_missing_from_the_store_vanish(spark):
    ctx = corpus(spark, [("x", 1, "name"), ("x", 2, "name")], 50, ids=[1])
    assert ids(eval_unit(QueryUnit("q", (Lexical(["x"]),)), ctx)) == [1]


def test_scores_of_units(spark):
    hits = spark.createDataFrame([(1, "a", 0, "lexical", "x", "name", 0.2), (1, "a", 0, "lexical", "y", "name", 0.3), (1, "b", 0, "lexical", "x", "doc", 0.4), (1, "b", -1, "combined", "max(1 signals)", "", 0.4)], "symbol_id long, unit string, satisfier int, signal string, detail string, field string, score double")
    ctx = graph(spark, [(1, 2)])
    frag = Frag.of(ctx.symbols, hits=hits)
    assert {(r.unit, round(r.score, 6)) for r in frag.scores().collect()} == {("a", 0.5), ("b", 0.4)}
    assert [round(r.score, 6) for r in frag.score().orderBy("symbol_id").collect()] == [0.9, 0.0]
    assert {r.why for r in S.reasons(frag).collect()} == {"x@doc, y@name, x@name"}
    assert ids(S.top(frag, 1)) == [1]
    assert ids(S.top(frag, 0)) == []
    with pytest.raises(ValueError):
        S.top(frag, -1)


def test_narrowing(spark):
    ctx = graph(spark, [(1, 2), (1, 2), (3, 2), (2, 4, "contains")], range(1, 6))
    frag = Frag.of(ctx.symbols)
    assert ids(S.only(frag, kind="class")) == [3]
    assert ids(S.only(frag, kind=[])) == []
    assert ids(S.only(frag, where=ctx.symbols.symbol_id > 3)) == [4, 5]
    assert ids(S.degree(frag, ctx, min_in=3)) == [2]
    assert ids(S.degree(frag, ctx, edge=None, max_in=0, max_out=0)) == [5]
    assert ids(S.degree(frag, ctx, edge=[], max_in=0)) == [1, 2, 3, 4, 5]
    assert ids(S.degree(frag, ctx)) == [1, 2, 3, 4, 5]


class Strict(Judge):
    def judge(self, concept, candidates):
        if any(c["symbol_id"] == 4 for c in candidates):
            raise RuntimeError("down")
        return [(c["symbol_id"], "yes" if c["symbol_id"] % 2 else "no", 0.9, "odd") for c in candidates[:-1]] + [(99, "yes", 1.0, "")]


def test_intent_degrades(spark):
    ctx = graph(spark, [(1, 2)], range(1, 7))
    ctx.judge = Strict()
    frag = Frag.of(ctx.symbols)
    assert ids(intent(frag, "odd", ctx, batch_size=3, fallback="drop")) == [1]
    assert ids(intent(frag, "odd", ctx, batch_size=3)) == [1, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        intent(frag, "odd", ctx, max_items=3)


@pytest.mark.parametrize("seed", range(3))
def test_algebra(spark, seed):
    import random

    rng = random.Random(seed)
    edges = [(rng.randrange(9), rng.randrange(9)) for _ in range(14)]
    ctx = graph(spark, edges, range(9))
    pick = lambda: Frag.of(ctx.symbols, ctx.edge_table).induced(rng.sample(range(9), 5))
    a, b = pick(), pick()
    assert a | a == a
    assert set(ids(a & b)) == set(ids(a)) & set(ids(b))
    assert set(ids(a - b)) == set(ids(a)) - set(ids(b))
    assert set(ids(a | b)) == set(ids(a)) | set(ids(b))
    for f in (a & b, a - b, a | b):
        inside = set(ids(f))
        assert all(r.src in inside and r.dst in inside for r in f.edges.collect())
    enters = {r.dst for r in a.edges.collect()}
    assert set(ids(a.roots())) == set(ids(a)) - enters
    with pytest.raises(TypeError):
        hash(a)
    assert math.isfinite(len(a))
