import pytest

from fragmill.operators import measures as M
from fragmill.operators import select as S
from fragmill.operators.units import Lexical, QueryUnit
from fragmill.plans.build import build_spec
from fragmill.plans.cost import estimate_hop, estimate_intent, estimate_units
from fragmill.plans.planner import Boost, Cohere, EvalUnit, Narrow, plan
from fragmill.plans.script import ScriptError, check, run_script, to_script
from fragmill.plans.spec import GraphConstraint, QuerySpec, hops_of, kinds_of
from fragmill.search import NO_WORD, search
from tests.helpers import corpus, graph, ids


@pytest.fixture(scope="module")
def ctx(spark):
    posts = [("rare", i, "name") for i in range(1, 30)] + [("common", i, "name") for i in range(1, 160)] + [("all", i, "doc") for i in range(1, 400)] + [("alone", 5, "name")]
    c = corpus(spark, posts, 400, ids=range(1, 401))
    c.edges = graph(spark, [(i, i + 1) for i in range(1, 120)] + [(i, i + 2, "contains") for i in range(1, 60)]).edges
    return c


def units(*words):
    return tuple(QueryUnit(w, (Lexical([w]),)) for w in words)


def test_estimates(spark, ctx):
    one = corpus(spark, [(t, i, "name") for t in ("a", "b") for i in range(100)], 1000)
    assert estimate_units([QueryUnit("u", (Lexical(["a", "b"]),))], one)["u"].rows == 190
    assert estimate_hop(10, 1000, 4.0, (1, 2)).rows == 200
    assert estimate_hop(10, 1000, 4.0, (1, 2), 100).rows == 20
    assert estimate_intent(10).cost == 50_000


def test_plan_order(ctx):
    p = plan(QuerySpec(units("common", "all", "rare"), (GraphConstraint("common", "rare"),), limit=7), ctx)
    assert [type(s) for s in p.steps] == [EvalUnit, EvalUnit, Boost, Cohere, Narrow]
    assert [s.unit.name for s in p.steps[:2]] == ["rare", "common"]
    assert p.steps[0].seed and (p.steps[2].src, p.steps[2].dst) == ("rare", "common")
    assert p.steps[-1].limit == 7
    assert p.steps[1].unit.satisfiers[0].weight == pytest.approx(0.5 * (1 - 159 / 400))
    assert "all" in p.explain()
    only = plan(QuerySpec(units("all")), ctx)
    assert [s.unit.name for s in only.steps if isinstance(s, EvalUnit)] == ["all"]


def test_script_of_a_plan_gives_the_same(ctx):
    p = plan(QuerySpec(units("common", "rare"), (GraphConstraint("common", "rare"),), kinds=("class",), limit=25), ctx)
    state = p.run(ctx, measure=True)
    assert [t[2] for t in state.trace] == [29, 159, 159, 159, 25]
    text = to_script(p)
    assert ids(run_script(text, ctx)) == ids(state.current)


def test_script_gate(ctx):
    for bad in ("import os", "answer = (1).__class__", "def f():\n  pass", "x = open", "answer = 1", "while True:\n  x = 1", "__x = 1", "a = [].sort()"):
        with pytest.raises((ScriptError, NameError)):
            run_script(bad, ctx, budget=2000)
    with pytest.raises(ScriptError):
        check("\n" * 300)


def test_specs():
    with pytest.raises(ValueError):
        QuerySpec(())
    with pytest.raises(ValueError):
        QuerySpec(units("a"), (GraphConstraint("a", "b"),))
    spec = QuerySpec.from_dict({"units": [{"name": "a", "terms": ["X", 3]}, {"name": "b", "modifiers": ["static"]}], "graph": [{"src": "a", "dst": "b", "hops": [3, 1], "edge": ["contains"]}, {"src": "a"}, 5], "kinds": "class", "limit": -1})
    assert spec.graph[0].edge == ("contains",) and spec.units[0].satisfiers[0].terms == ["x"]
    for bad in ({"units": []}, {"units": [{"name": "a"}]}, {"units": [7]}, {"units": [{"terms": ["y"]}]}, {"units": [{"name": "a", "terms": ["x"]}, {"name": "a", "terms": ["y"]}]}, {"units": [{"name": "a", "terms": ["x"]}], "graph": [{"src": "a", "dst": "z"}]}):
        with pytest.raises(ValueError):
            QuerySpec.from_dict(bad)
    assert [u.name for u in spec.units] == ["a", "b"] and spec.graph[0].hops == (1, 3) and spec.limit is None
    assert "interface" in spec.kinds
    assert [hops_of(x) for x in ([], [2], 3, "x", [5, 2], -1)] == [(1, 2), (1, 2), (3, 3), (1, 2), (2, 5), (1, 2)]
    assert kinds_of(["Method"]) == ("method", "constructor")


def test_partition_and_build(spark):
    posts = [(t, i, "name") for t in ("buf", "pool") for i in range(10)] + [(t, i, "name") for t in ("disk", "file") for i in range(50, 62)] + [("hub", i, "name") for i in range(60)] + [("stray", 99, "name")]
    c = corpus(spark, posts, 200, ids=range(200))
    assert M.partition(c, ["buf", "pool", "disk", "file", "hub", "stray"]) == [["buf", "pool", "hub", "stray"], ["disk", "file"]] or M.partition(c, ["buf", "pool", "disk", "file", "hub", "stray"]) == [["buf", "pool"], ["disk", "file", "hub", "stray"]]
    spec, notes = build_spec("q", ["buf", "pool", "nothing"], c, groups=[["buf", "disk"]])
    assert len(spec.units) == 1 and notes
    with pytest.raises(ValueError):
        build_spec("q", ["nothing"], c)


def test_search_routes(ctx):
    got = search("Where is the RARE alone?", ctx, limit=5)
    assert [r["rank"] for r in got.hits.collect()] == [1, 2, 3, 4, 5]
    assert got.hits.first().symbol_id == 5
    assert search("nothing here", ctx).notes == [NO_WORD]
    planned = search("rare common", ctx, route="planned", limit=5)
    assert planned.route == "planned" and planned.hits.count() == 5
    failed = search("rare", ctx, route="script", script=lambda q, c: "import os")
    assert failed.route == "lexical" and "failed" in failed.notes[0]
    assert search("rare", ctx, route="script").notes
    with pytest.raises(ValueError):
        search("x", ctx, route="magic")
    assert ids(S.top(got.frag, 1)) == [5]
