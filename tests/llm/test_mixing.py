import re

from fragmill.llm import mixing

SCHEMA = "doc_id long, text string, source string, target long"


def expected_targets(sizes, cap=3.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, open_, rest = {}, list(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > cap * sizes[s]]
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            rest -= out[s]
            open_.remove(s)
    return out


def corpus():
    rows = [(k, " ".join(["w"] * (k * 7 % 23)), f"s{k % 5}" if k % 11 else None, 1) for k in range(400)]
    rows += [(900 + k, "a b c", "tiny", 1) for k in range(2)] + [(950, None, "empty", 1), (951, " \t", "empty", 1)]
    return rows + [(960, "x y", "twice", 1)] * 3


def test_targets_and_takes(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, most = {}, {}
    for _, text, source, _ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
        most[source] = max(most.get(source, 0), n)
    want = expected_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6
        assert r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= most[source] / 2 + 1e-6
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_every_document_has_its_share_on_average(spark):
    rows = [(k + 1000 * s, "w " * (k % 9 + 1), f"{k % 2}{s}", 0) for s in range(60) for k in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    got["off"] = got.copies - got.target / got.source_size
    assert abs(got.groupby("size").off.mean()).max() < 0.12


def test_copies_and_empty(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    taken = mixing.mix(docs, h=mixing.F.xxhash64(*docs.columns)).groupBy("doc_id").agg(mixing.F.sum("copies").alias("n"))
    want = {r.doc_id: r.n for r in taken.collect() if r.n}
    got = {r.doc_id: r["count"] for r in mixing.copied(docs).groupBy("doc_id").count().collect()}
    assert got == want
    assert mixing.copied(docs).columns == docs.columns
    assert mixing.op1(docs.limit(0)).count() == 0


def test_equal_rows_share_their_copies(spark):
    """Thousands of equal rows are one group: the source still meets its target, and the rows stay."""
    rows = [(1, "a b c", "hot")] * 5000 + [(None, "d e", "hot")] * 5000 + [(k, "w " * (k % 9 + 1), f"s{k % 3}") for k in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.op1(docs).toPandas()
    assert len(got) == len(rows)
    for _, own in got.groupby("target"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max() / 2 + 1e-6
        assert (own.taken <= 3 * own["size"]).all()
    equal = got[got.doc_id == 1].copies
    assert len(equal) == 5000 and equal.max() - equal.min() <= 1
    n = mixing.copied(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in n if r.doc_id == 1 or r.doc_id is None} == {1: equal.sum(), None: got[got.doc_id.isna()].copies.sum()}
