"""Paths that only large tables take give the rows of the paths that small ones take."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fragmill.llm import components, minhash, mixing, runtime


def test_a_small_share_of_a_large_table_is_not_none(spark):
    share = 6_000 / 2.5e10
    assert int(share * 2.0**63) > 2**40
    rows = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    for share, low, high in ((0.01, 1800, 2200), (1.0, 200_000, 200_000), (0.0, 0, 0), (6_000 / 2.5e10, 0, 2)):
        assert low <= rows.where(runtime.sampled(F.col("h"), share)).count() <= high


def test_star_rounds_equal_one_task(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(700, 740)] + [(5, 5), (None, 3)]
    nodes = spark.range(800)
    frame = spark.createDataFrame(edges, "a long, b long")
    want = sorted(map(tuple, components.connected_components(nodes, frame).collect()))
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert sorted(map(tuple, components.connected_components(nodes, frame).collect())) == want


def test_salted_joins_and_ranks_equal_broadcasts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "w " * (k % 13), f"s{k % 7}" if k % 9 else None) for k in range(300)], "doc_id long, text string, source string")
    want = sorted(map(str, mixing.op1(docs).collect()))
    for module in (runtime, mixing):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.op1(docs).collect())) == want


def test_blocks_by_shingles(spark, monkeypatch):
    """Buckets cut into blocks of a few shingles, with stars rounds of several tasks, link what brute force links."""
    from tests.llm.test_minhash import brute, group

    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "SHINGLES", 400)
    monkeypatch.setattr(components, "ONE_TASK", 0)
    rows = group(random.Random(7), 40, words=60, edits=5)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 85)


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(RuntimeError, match=re.escape("spark.checkpoint.dir")):
        runtime.ensure_checkpoint_dir(Session())
