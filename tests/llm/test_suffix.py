import hashlib
import random

import numpy as np
import pyarrow as pa

from fragmill.llm import suffix


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in texts:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for i, b in texts:
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mark[k : k + length] = True
        edges = np.diff(np.concatenate([[0], mark.astype(int), [0]]))
        out.append((i, len(b), int(mark.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mark])).hexdigest()))
    return sorted(out)


def test_maximal_repeats_list_all_occurrences():
    rng = random.Random(3)
    for _ in range(120):
        length = rng.choice([8, 9, 12, 16, 20, 33])
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 120))) for _ in range(4)]
        bodies = [b"".join(rng.choice(base)[rng.randrange(20) : rng.randrange(20, 120)] for _ in range(rng.randrange(1, 4))) or b"x" for _ in range(rng.randrange(1, 8))]
        for depth, found in suffix.maximal_repeats(bodies, length):
            text = bodies[found[0][0]][found[0][1] : found[0][1] + depth]
            assert set(found) == {(k, i) for k, b in enumerate(bodies) for i in range(len(b) - depth + 1) if b[i : i + depth] == text}
            assert depth >= length and len(found) > 1
            before = {bodies[k][i - 1] if i else (k,) for k, i in found}
            after = {bodies[k][i + depth] if i + depth < len(bodies[k]) else (k,) for k, i in found}
            assert len(before) > 1 and len(after) > 1


def test_segments_of_equal_windows_share_an_anchor():
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcde ") for _ in range(1500))
    docs = [text[:700], text[300:1200], text[600:640], b"", text]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    row, first, count, h = suffix.segments(np.frombuffer(b"".join(docs), np.uint8), at, 200)
    anchors, seen = {}, set()
    for r, f, c, x in zip(row, first, count, h, strict=True):
        for k in range(f, f + c):
            seen.add((r, k))
            assert anchors.setdefault(docs[r][k : k + 200], x) == x
    assert len(seen) == sum(max(0, len(d) - 199) for d in docs)


def test_repeats_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 2000)
    monkeypatch.setattr(suffix, "PIECE", 3000)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line, base = text(60), text(20), text(150)
    rows = [(k, text(30) + passage + text(rng.randrange(60))) for k in range(25)] + [(100 + k, line + text(80)) for k in range(30)]
    for k in range(25):
        near = base.split()
        near[rng.randrange(150)] = "edit"
        rows.append((200 + k, " ".join(near)))
    rows += [(300, "ab " * 300), (301, None), (302, ""), (303, text(5)), (304, text(3000) + passage), (305, base), (305, base), (306, text(40)), (306, text(50))]
    docs = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, uid string")
    got = suffix.op6(docs).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 200)
    assert suffix.op6(docs.limit(0)).count() == 0


def test_hot_anchor_is_taken_in_blocks(monkeypatch):
    """Distinct segments of one anchor never meet in one array beyond the bound."""
    seen, blocks = [], []
    inner = suffix.SuffixArray
    monkeypatch.setattr(suffix, "BLOCK", 4000)
    monkeypatch.setattr(suffix, "SuffixArray", lambda bodies, length: (seen.append(sum(map(len, bodies))), inner(bodies, length))[1])
    if hasattr(suffix, "hot_block"):
        whole = suffix.hot_block
        monkeypatch.setattr(suffix, "hot_block", lambda h, fps, bodies, counts, length: (blocks.append(sum(map(len, bodies))), whole(h, fps, bodies, counts, length))[1])
    rng = random.Random(2)
    bodies = [bytes(rng.choice(b"abcd") for _ in range(300)) for _ in range(100)]
    batch = pa.RecordBatch.from_pydict({"h": [7] * 100, "fp": list(range(100)), "body": bodies, "left": pa.array([-1] * 100, pa.int16()), "part": pa.array([1] * 100, pa.int32())})
    list(suffix._covered(200)(iter([batch])))
    assert sum(seen) + sum(blocks) == 30_000
    assert max(seen + blocks) <= 4000 + 300


def test_hot_anchors_match_brute_force(spark, monkeypatch):
    """Repeats across the blocks and parts of hot anchors: a passage whose ends differ in most documents and agree in some."""
    monkeypatch.setattr(suffix, "BLOCK", 3000)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(500)
    starts, ends = [text(160) for _ in range(6)], [text(160) for _ in range(6)]
    rows = []
    for k in range(160):
        # Neighbours agree over 0 to 160 bytes on either side of the passage.
        a, b = rng.randrange(161), rng.randrange(161)
        rows.append((k, text(200) + rng.choice(starts)[160 - a :] + passage + rng.choice(ends)[:b] + text(200)))
    rows += [(500 + k, rows[0][1]) for k in range(40)] + [(600, text(900)), (601, None), (602, passage[:230] + text(100)), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, _, held = suffix._prepared(docs, 200)
    assert held.selectExpr("explode(runs) r").where("r.parts > 1").count() > 100
    assert sorted(tuple(r) for r in suffix.op6(docs).collect()) == brute(rows, 200)


def test_equal_rows_are_linear(spark):
    """Thousands of equal rows, with and without a doc_id, next to texts that share a part of them."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    body, short = text(1200), text(150)
    rows = [(1, body)] * 5000 + [(None, body)] * 5000 + [(2, short)] * 3000 + [(3, text(300) + body[200:700] + text(300)), (4, text(900))]
    got = sorted((tuple(r) for r in suffix.op6(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    whole = hashlib.sha256(b"").hexdigest()
    few = brute([(1, body)] * 2 + [(2, short)] * 2 + rows[-2:], 200)
    want = [(i, 1200, 1200, 1, whole) for i in (1, None) for _ in range(5000)] + [x for x in few if x[0] == 2] * 1500 + [x for x in few if x[0] > 2]
    assert got == sorted(want, key=str)


def test_repeat_groups_list_every_occurrence(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(320)
    rows = [(k, text(50 * k) + passage + text(90)) for k in range(6)] + [(10, text(700)), (11, passage[40:300]), (12, None)]
    rows += [(20, passage)] * 3
    texts = {i: (t or "").encode() for i, t in rows}
    found = suffix.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for r in found:
        groups.setdefault((r.repeat, r.depth), set()).add((r.doc_id, r.start))
        if r.goes_on:
            assert len({texts[x.doc_id][x.start - 1] for x in found if (x.repeat, x.depth) == (r.repeat, r.depth)}) == 1
    for (_, depth), places in groups.items():
        (body,) = {texts[i][s : s + depth] for i, s in places}
        assert depth >= 200 and len(places) > 1
        assert places == {(i, s) for i, t in texts.items() for s in range(len(t)) if t.startswith(body, s)}
    # What the groups cover is what the query removes of rows that are there once.
    removed = {r.doc_id: r.n_removed for r in suffix.op6(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        mark = np.zeros(len(texts[i]), bool)
        for (_, depth), places in groups.items():
            for d, s in places:
                if d == i:
                    mark[s : s + depth] = True
        assert mark.sum() == removed[i] >= 320
