import hashlib
import random
import re

from fragmill.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        have, hit, found = words(text), set(), set()
        for item, line in items:
            w = words(line)
            n = min(window, len(w))
            wanted = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            for k in range(len(have) - n + 1):
                if tuple(have[k : k + n]) in wanted and item is not None:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(have), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(have)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé9") for _ in range(rng.randrange(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(k, line(n)) for k, n in enumerate((40, 13, 20, 12, 3, 1))] + [(10, ""), (11, None), (None, line(20)), (1, line(15)), (12, "Über, ALLES!")]
    docs = [(k, line(rng.randrange(80))) for k in range(30)]
    docs += [(100 + k, line(20) + "!! " + (items[k % 6][1]).upper().replace(" ", " -- ") + "\n" + line(rng.randrange(200))) for k in range(24)]
    docs += [(200, None), (201, ""), (202, "  .. "), (203, items[0][1]), (203, items[0][1]), (204, "über alles"), (205, line(30) + " " + " ".join(words(items[0][1])[:13]) + "x")]
    return docs, items


def test_scan_matches_brute_force(spark, monkeypatch):
    docs, items = tables()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert sorted((tuple(r) for r in decontam.op9(d, b).collect()), key=str) == want
    monkeypatch.setattr(decontam, "SLICE_BYTES", 60)
    assert sorted((tuple(r) for r in decontam.op9(d, b).collect()), key=str) == want
    assert decontam.op9(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontam.op9(d, b.limit(0)).collect()} == {0}


def test_offsets_point_into_the_original(spark):
    text = "Né -- Alpha BETA, gamma; end"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "beta gamma"), (2, "né alpha")], "item_id long, text string")
    row = decontam.scan(d, b).first()
    assert [text.encode()[r.start : r.end].decode() for r in row.runs] == ["Né -- Alpha BETA, gamma"]
