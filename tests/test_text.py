import random
import re

from pyspark.sql import functions as F

from fragmill.functions import text as T
from fragmill.operators import grounding as GR


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_identifiers(spark):
    assert one(spark, "parseHTTPResponse", T.split_identifier("t"))[0] == ["parse", "http", "response"]
    assert one(spark, "utf8_toString2", T.split_identifier("t"))[0] == ["utf", "to", "string"]
    assert one(spark, None, T.split_identifier("t"), T.words_of("t"))[:] == ([], [])
    assert one(spark, "A bc Été def", T.words_of("t", 2))[0] == ["bc", "def"]
    assert one(spark, "GET, path_1 = 42, get", T.argument_tokens("t"))[0] == ["get", "path_1"]


def test_camel_split_equals_lookaround(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abXY9_") for _ in range(rng.randrange(12))) for _ in range(300)]
    boundary = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    want = [[w.lower() for w in boundary.sub(" ", re.sub("[^A-Za-z]+", " ", n)).split()] for n in names]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "t string").select(T.split_identifier("t")).collect()]
    assert got == want


def test_skeleton_and_rules(spark):
    assert one(spark, "message", T.skeleton("t"))[0] == "msg"
    words = spark.createDataFrame([(w,) for w in ("buf", "buffer", "msg", "message", "ctx", "context", "io")], "word string")
    pairs = GR.lexical_pairs(words, words.withColumnRenamed("word", "term"))
    assert sorted((r.key, r.target, r.score, r.reason) for r in pairs.collect()) == [("buffer", "buf", 0.75, "prefix"), ("context", "ctx", 0.5, "subseq"), ("message", "msg", 0.75, "abbrev")]


def test_vector_scores(spark):
    row = spark.range(1).select(GR.vector_score(F.lit(0.55)), GR.vector_score(F.lit(1.0)), GR.vector_score(F.lit(0.775))).first()
    assert row[:] == (None, 0.6, 0.3)


def test_segments(spark):
    lexicon = {"io": 500, "stat": 200, "iostat": 3, "interface": 400, "inter": 5, "face": 5, "read": 50}
    n = sum(lexicon.values())
    import math

    cost = {w: math.log(n) - math.log(c) for w, c in lexicon.items()}
    assert T.segment("iostat", cost, 9) == ("io", "stat")
    for whole in ("interface", "nfsd", "zzzread", "read"):
        assert T.segment(whole, cost, 9) == ()
    terms = spark.createDataFrame([(w,) for w in lexicon], "term string")
    got = T.segmented(terms, spark.createDataFrame(list(lexicon.items()), "term string, n long")).collect()
    assert [(r.term, r.pieces) for r in got] == [("iostat", ["io", "stat"])]


def test_fuzzy_and_abbreviations():
    assert T.fuzzy_score("get user", "get user") == 1.0
    assert T.fuzzy_score("get user", "Get User") == 0.98
    assert T.fuzzy_score("get user name", "get user id") == 0.0 or T.fuzzy_score("get user name", "get user id") >= 0.65
    assert T.fuzzy_score("alpha", "omega") == 0.0
    found = T.abbreviations("message queue")
    assert {"mq", "msgqueue", "messagequeue"} <= set(found)
    assert len(T.abbreviations("a very long phrase of many words", 100)) <= 101


def test_json_in_text():
    assert T.json_in('say ```json\n[{"a": 1}]\n``` so') == [{"a": 1}]
    assert T.json_in("{'no'") is None


def test_subterms_and_windows(spark):
    row = spark.range(1).select(T.ordered_subterms(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).first()[0]
    assert sorted(row) == ["a", "a b", "a b c", "a c", "b", "b c", "c"]
    lines = spark.range(1).select(T.window_corpus(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).first()[0]
    assert sorted(map(tuple, lines)) == sorted([("a", "b", "c")] * 3 + [("a", "b")] * 5 + [("b", "c")] * 5)
