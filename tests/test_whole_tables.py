"""The queries over every row, against brute force on a small fixture."""

import random
import re
from itertools import product

import pytest

from fragmill import catalog
from fragmill.operators import grounding as GR


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(8)
    out = {
        "orders": ([(k, rng.randrange(70)) for k in range(1, 121)], "o_orderkey long, o_custkey long"),
        "events": ([(k, rng.choice("ab"), rng.randrange(500), rng.uniform(0, 130)) for k in range(200)], "event_id long, event_type string, user_id long, value double"),
        "supplier": ([(k, rng.randrange(25)) for k in range(1, 16)], "s_suppkey long, s_nationkey int"),
    }
    path = tmp_path_factory.mktemp("small")
    for name, (rows, schema) in out.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path), {name: rows for name, (rows, _) in out.items()}


def result(spark, small, name):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, small[0]).collect())


def test_meta_closure(spark, small):
    direct = {(str(c % 12), str(k % 60)) for k, c in small[1]["orders"] if k % 60 != c % 12}
    best, now = {}, {(a, b): 1.0 for a, b in direct}
    for _ in range(3):
        for pair, score in now.items():
            best[pair] = max(best.get(pair, 0), score)
        now = {(a, d): score * 0.8 for ((a, b), score), (c, d) in product(now.items(), direct) if b == c}
    want = sorted((a, b, round(s, 6), "meta") for (a, b), s in best.items() if a != b)
    assert result(spark, small, "x12_meta_closure") == want
    assert len(want) > 100


def test_range_match(spark, small):
    events = small[1]["events"]
    ranges = [(k, t, u % 80, u % 80 + k % 37) for k, t, u, _ in events]
    want = []
    for k, t, _, v in events:
        around = [(b - a, r) for r, f, a, b in ranges if f == t and a <= int(v) <= b]
        tight = [r for w, r in around if w == min(around)[0]]
        want += [(k, tight[0])] if len(tight) == 1 else []
    assert result(spark, small, "j8_range_match") == want
    assert 0 < len(want) < len(events)


def test_impl_resolution(spark, small):
    by = {}
    for k, c in small[1]["orders"]:
        by.setdefault(c, set()).add(k)
    want = sorted((k, c, min(by[c]) if len(by[c]) == 1 else None, "resolved" if len(by[c]) == 1 else "ambiguous") for k, c in small[1]["orders"])
    assert sorted(result(spark, small, "j11_impl_resolution"), key=str) == sorted(want, key=str)
    assert {w[3] for w in want} == {"resolved", "ambiguous"}


def test_equivalents(spark, small):
    pairs = [(n, k % 25) for k, n in small[1]["supplier"] if n != k % 25]
    comp = {x: x for p in pairs for x in p}
    for _ in comp:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert result(spark, small, "j10_equivalents") == sorted(comp.items())
    assert len(set(comp.values())) > 1


def test_vocabulary_of_whole_texts(spark, tmp_path):
    """Words after the fortieth count, once for each doc_id, however many rows it has."""
    filler = " ".join(f"{'abcdefgh'[k % 8]}{'abcdefgh'[k // 8]}" for k in range(50))
    rows = [(k, f"{filler} zebra zebrawood", "en", "src") for k in (1, 2, 2)] + [(k, filler, "en", "src") for k in range(3, 20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    words, targets = catalog._whole_vocabulary(spark, str(tmp_path))
    assert {"zebra", "zebrawood"} <= {r.word for r in words.collect()}
    assert {r.term: r.df for r in targets.where("term LIKE 'zeb%'").collect()} == {"zebra": 2, "zebrawood": 2}
    assert ("zebrawood", "zebra", 1) in {tuple(r) for r in catalog.QUERIES["w5_topk_per_key"](spark, str(tmp_path)).collect()}


def test_subsequences_of_words(spark):
    words = spark.createDataFrame([("abcde",), ("abc",)], "word string")
    df = words.select(GR.short_subsequences("word").alias("s"), "word")
    assert {r.word: sorted(r.s) for r in df.collect()} == {"abcde": sorted(["abc", "abd", "abe", "acd", "ace", "ade", "abcd", "abce", "abde", "acde"]), "abc": []}


@pytest.mark.parametrize(("small", "most"), [(True, 1), (False, 0)])
def test_words_do_not_pass_the_driver(spark, monkeypatch, small, most):
    """Of all that rules join, only the counted short targets may be broadcast; exploded words look small to Spark and are not."""
    if not small:
        monkeypatch.setattr(GR, "maybe_broadcast", lambda df: df)
    names = ["".join(x) for n in (3, 4, 5) for x in product("abc", repeat=n)]
    words = spark.createDataFrame([(x,) for x in names], "word string")
    targets = spark.createDataFrame([(x,) for x in names[::3]], "term string")
    pairs = GR.lexical_pairs(words, targets)
    ran = pairs._jdf.queryExecution()
    assert ran.toRdd().count() > 100
    final = ran.executedPlan().toString().split("Initial Plan")[0]
    assert final.count("BroadcastHashJoin") == most
    assert final.count("SortMergeJoin") == 3 - most


def test_rules_list_disjoint_pairs(spark):
    """Each pair once, by the first rule that holds, against all pairs; each rule alone gives the same rows."""
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcr") for _ in range(rng.randrange(2, 9))) for _ in range(300)})
    words = spark.createDataFrame([(x,) for x in names + names[:9]], "word string")
    targets = spark.createDataFrame([(x,) for x in names[::2] + names[:10:2]], "term string")
    bone = {x: x[0] + re.sub(r"(.)\1+", r"\1", re.sub("[aeiou]", "", x[1:])) for x in names}

    def rule(key, target):
        if len(target) < 3 or len(key) <= len(target):
            return None
        if key.startswith(target):
            return "prefix"
        if bone[key] == bone[target]:
            return "abbrev"
        letters = iter(key[1:])
        held = key[0] == target[0] and len(target) <= 5 and len(key) <= 3 * len(target) and all(c in letters for c in target[1:])
        return "subseq" if held else None

    want = sorted((k, t, 0.5 if r == "subseq" else 0.75, r) for k, t in product(names, names[::2]) if (r := rule(k, t)))
    assert sorted(map(tuple, GR.lexical_pairs(words, targets).collect())) == want
    for reason in GR.RULES:
        alone = [x for x in want if x[3] == reason]
        assert len(alone) > 50
        assert sorted(map(tuple, GR.lexical_pairs(words, targets, [reason]).collect())) == alone


@pytest.mark.parametrize("name", ["x9_prefix", "x9_abbrev"])
def test_one_rule_joins_for_itself_alone(spark, tmp_path, name):
    """A query of one rule neither lists subsequences, nor broadcasts, nor gathers the pairs of all rules."""
    rows = [(k, "zebra zbr zebrawood contract cntrct", "en", "src") for k in (1, 2)] + [(k, "else", "en", "src") for k in range(3, 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ran = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution()
    assert ran.toRdd().count() >= 1
    final = ran.executedPlan().toString().split("Initial Plan")[0]
    assert final.count("SortMergeJoin") == 1
    assert "Broadcast" not in final
    assert "min(rule" not in final


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_abbreviations_are_never_broadcast(spark, tmp_path, adaptive):
    """However high the session's thresholds are, no rows of x9_abbrev come to the driver for a broadcast."""
    rows = [(k, "message mesage msg msgs context contxt", "en", "src") for k in (1, 2)] + [(k, "else", "en", "src") for k in range(3, 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1g", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1g", "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pairs = catalog.QUERIES["x9_abbrev"](spark, str(tmp_path))
        got = sorted((r.key, r.target) for r in pairs.collect())
        final = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == [("context", "contxt"), ("mesage", "msg"), ("message", "mesage"), ("message", "msg")]
    assert "Broadcast" not in final
    assert "Join" in final
