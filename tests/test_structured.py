"""Named filters, exact lines, surface conditions and intention plans."""

import pytest

from fragmill.operators import structured as X
from fragmill.plans import structured as PS


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [(1, "loadUser", "method", "a/b.py", (1, 3)), (2, "User", "class", "a/b.py", (1, 9)), (3, "save_user", "method", "c/b.py", (1, 2)), (4, "noSpan", "field", "c/b.py", (0, 0))]
    return spark.createDataFrame(rows, "symbol_id long, name string, kind string, file string, span struct<start:int,end:int>")


def ids(df):
    return sorted(r.symbol_id for r in df.select("symbol_id").collect())


def test_filters_by_name(symbols):
    assert ids(X.filtered(symbols, "types", types=["METHOD"])) == [1, 3]
    assert ids(X.filtered(symbols, "path", wanted="b.py")) == [1, 2, 3, 4]
    assert ids(X.filtered(symbols, "path", wanted="c")) == [3, 4]
    with pytest.raises(KeyError):
        X.filtered(symbols, "nothing")
    with pytest.raises(ValueError):
        X.symbol_filter("types")(X.of_types)


def test_exact_lines(spark, symbols):
    files = spark.createDataFrame([("a/b.py", "x = 1\nreturn   user\n\nreturn user\ny"), ("c/b.py", "z\nreturn users"), ("n", None)], "file string, text string")
    got = X.exact_lines(symbols, X.source_lines(files), [("  return user ", True), ("z", False)])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "  return user ", 2, 2.6), (2, "  return user ", 2, 2.6), (3, "z", 1, 2.0)]


def test_exact_elements_without_names(spark):
    rows = spark.createDataFrame([(1, None, "method", "find_it", None), (2, "", "method", "", "x/y.c")], "symbol_id long, name string, kind string, signature string, file string")
    got = X.exact_elements(rows, [("findIt", "function", True), ("", "unknown", True), ("y.c", "file", False), ("z/x/y.c", "file", False)])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "findIt", "signature", 1.65), (2, "y.c", "file", 1.45)]


def test_conditions(symbols):
    with pytest.raises(ValueError):
        PS.SurfaceCondition.of({"include": [["a"]], "rules": [(0, 1, 1)]})
    assert PS.SurfaceCondition.of({}).run(symbols) == ("empty", None)
    assert ids(PS.surface(symbols, [PS.SurfaceCondition.of({"exclude": [["user"]]})])) == [4]


def test_intention(spark):
    rows = [(k, f"c{k % 5}", (k % 5) / 5, k / 40, 0.3, 0.0) for k in range(40)]
    candidates = spark.createDataFrame(rows, "symbol_id long, cluster string, cluster_score double, score double, include double, exclude double")
    plan = PS.IntentionPlan(defer=False, gray="drop")
    judge = lambda gray: gray.where("symbol_id < 20").selectExpr("symbol_id", "symbol_id % 2 = 0 AS keep")
    got = {r.symbol_id: (r.stage, r.decision) for r in PS.intention(candidates, plan, judge).collect()}
    for k, *_ in rows:
        if k % 5 < 2:
            assert got[k] == ("cluster", "discard")
        elif k < 20:
            assert got[k] == ("judge", "keep" if k % 2 == 0 else "discard")
        else:
            assert got[k] == ("left", "discard")
    assert len(got) == 40
    assert {d for _, d in ((r.stage, r.decision) for r in PS.intention(candidates, PS.IntentionPlan(cluster=False)).collect())} == {"keep"}
    with pytest.raises(ValueError):
        PS.IntentionPlan(gray="maybe")


def test_few_or_like_clusters_stay(spark):
    rows = lambda scores: spark.createDataFrame([(k, str(k), s, 0.5) for k, s in enumerate(scores)], "symbol_id long, cluster string, cluster_score double, score double")
    tiers = lambda scores: [r.tier for r in X.cluster_tiers(rows(scores)).orderBy("symbol_id").collect()]
    assert tiers([0.9, 0.1]) == [1, 2]
    assert tiers([0.51, 0.50, 0.49]) == [1, 2, 3]
    assert tiers([0.9, 0.5, 0.1, 0.0, 0.2]) == [1, 2, 4, 4, 3]
    assert tiers([]) == []
