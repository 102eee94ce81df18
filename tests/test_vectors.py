from fragmill.operators import structured as X
from fragmill.operators import termmatch, vectors


def test_vocabulary_budget(spark):
    terms = spark.createDataFrame([("a", 9), ("b", 5), ("c", 1), ("d", 5)], "term string, df long")
    got = vectors.vocabulary_plan(terms, terms.where("term = 'c'"), 100, 100 * 12 * 1.35 * 3 / 1e6)
    assert sorted(r.term for r in got.collect()) == ["a", "b", "c"]


def test_initial_ladder(spark):
    known = spark.createDataFrame([("io", [1.0, 0.0]), ("stat", [0.0, 1.0]), ("buf", [0.5, 0.5])], "term string, v array<double>")
    terms = spark.createDataFrame([("io",), ("Buf",), ("iostat",), ("zzz",)], "term string")
    pieces = spark.createDataFrame([("iostat", ["io", "stat"])], "term string, pieces array<string>")
    got = {r.term: (r.origin, r.v) for r in vectors.initial_vectors(terms, known, pieces, 2).collect()}
    assert got["io"] == ("exact", [1.0, 0.0]) and got["Buf"] == ("canonical", [0.5, 0.5])
    assert got["iostat"] == ("components", [0.5, 0.5])
    assert got["zzz"] == ("seeded", vectors.seeded_normal("zzz", 2))


def test_expansion_takes_the_higher_score(spark):
    base = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "term string, v array<double>")
    got = {(r.key, r.target): r.reason for r in vectors.expansion(base, base, 2).collect()}
    assert got == {("a", "b"): "adapted", ("b", "a"): "adapted"}


def test_training(spark):
    lines = spark.createDataFrame([(["buf", "pool", "free"],), (["disk", "file", "read"],)] * 20, "words array<string>")
    assert {r.term for r in vectors.train(lines, dim=8).collect()} == {"buf", "pool", "free", "disk", "file", "read"}


def test_terms_reach_symbols_by_short_forms(spark):
    tokens = spark.createDataFrame([("msgq", 1), ("mq", 2), ("messagequeue", 3), ("queue", 4), ("other", 5)], "token string, symbol_id long")
    terms = spark.createDataFrame([("message queue",)], "term string")
    assert {r.symbol_id for r in termmatch.matches(terms, tokens).collect()} == {1, 2, 3, 4}
    pairs = termmatch.abbreviation_pairs(terms.withColumnRenamed("term", "phrase"), tokens).collect()
    assert {r.abbr for r in pairs} == {"msgq", "mq", "messagequeue"}


def test_clusters_and_ladders(spark):
    import numpy as np

    v = np.array([[1, 0], [0.99, 0.05], [0, 1], [0.05, 0.99], [-1, 0]])
    assert X.cluster_average(v).tolist() == [0, 0, 1, 1, 2]
    assert X.kept_clusters([0.9, 0.5, 0.1]) == [True, True, False]
    assert X.kept_clusters([0.5, 0.52, 0.51]) == [True] * 3
    rows = spark.createDataFrame([(k, k / 10, 0.0) for k in range(10)] + [(20, 0.9, 0.7)], "symbol_id long, include double, exclude double")
    got = {r.symbol_id: r.decision for r in X.adaptive_decision(rows).collect()}
    assert got[9] == "keep" and got[0] == "discard" and got[20] == "discard" and got[2] == "discard" and got[5] == "keep"
    groups = [rows.where("symbol_id < 5"), rows.where("symbol_id > 2")]
    assert sorted(r.symbol_id for r in X.and_hop(groups, None, []).collect()) == [3, 4]


def test_best_of_a_block_equals_the_full_sort():
    """Many ties; what cannot be among the best is not sorted."""
    import numpy as np

    from fragmill.operators.grounding import _best

    rng = np.random.default_rng(0)
    for n, k in ((3, 5), (40, 5), (200, 7)):
        cosine, names = np.round(rng.normal(size=(30, n)), 1), rng.permutation(n)
        _, column = _best(cosine, names, k)
        order = np.lexsort((np.broadcast_to(names, cosine.shape), -np.round(cosine, 9)), axis=1)[:, :k]
        assert (column.reshape(30, -1) == order).all()
