import random
import re

import numpy as np
import pytest

from fragmill.llm import minhash
from fragmill.llm.queries import op8_minhash_near_dedup


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def group(rng, copies, words=120, edits=4, start=0):
    base = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(words)]
    rows = []
    for k in range(copies):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        rows.append((start + k, " ".join(text)))
    return rows


@pytest.mark.parametrize(("rounds", "block"), [(0, 7), (1, 16), (3, 256)])
def test_links_match_brute_force(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PROBES", block - 2)
    rng = random.Random(5)
    rows = group(rng, 60, edits=7) + group(rng, 30, words=40, edits=3, start=100) + group(rng, 20, words=9, edits=1, start=200)
    rows += [(300, None), (301, ""), (302, "One Two"), (303, "one  two"), (304, "one"), (305, " \t\n"), (306, rows[0][1].upper())]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 85)


def test_clashing_columns_repeats_and_empty(spark):
    rows = [(1, "a b c d e f g", 9), (1, "a b c d e f g", 8), (2, "a b c d e f g", 7), (None, "a b c d e f g", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep long")
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, 1)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    sets = [pool[:1000], pool[100:1100], pool[:1], pool[:0]]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sketch = minhash.sketches(np.concatenate(sets), at, 512)
    unset = np.iinfo(np.uint64).max
    assert (sketch[:3] != unset).all()
    assert (sketch[3] == unset).all()
    assert abs((sketch[0] == sketch[1]).mean() - 900 / 1100) < 0.07


def test_query_over_a_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op8_minhash_near_dedup(spark, sf_dir).drop("kept").collect())
    assert got == brute([tuple(r) for r in docs], 3, 85)
