import zlib

import numpy as np
import pytest

from fragmill.llm import hilbert


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 3), (4, 2)])
def test_curve_visits_neighbours(n, bits):
    grid = np.stack([a.ravel() for a in np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")])
    index = hilbert.hilbert_index(grid, bits)
    assert sorted(index.tolist()) == list(range(1 << bits * n))
    walk = grid[:, np.argsort(index)].astype(int)
    assert (np.abs(np.diff(walk, axis=1)).sum(0) == 1).all()


def test_shards(spark):
    rows = [(k, "é" * (k % 50), ("en", "fr", None)[k % 3], f"s{k % 7}", 1) for k in range(1003)] + [(5000, None, None, None, 1)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    got = hilbert.op7(docs).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    assert sorted(per) == list(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in order)
    texts = {k: t or "" for k, t, *_ in rows}
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, hilbert.op7(docs.repartition(5)).collect()))
    assert hilbert.op7(docs.limit(0)).count() == 0
