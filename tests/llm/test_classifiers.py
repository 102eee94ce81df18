import random
import zlib

import numpy as np

from fragmill.llm import ftrl, langid, pulearn


def corpus(n, bad):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(rng.randrange(2, 8)))
    docs, labels = [], []
    for k in range(n):
        text = [word() for _ in range(rng.randrange(20, 120))]
        label = int(rng.random() < 0.3)
        if label:
            text = bad(rng, text)
        docs.append((k, " ".join(text), "x"))
        labels.append((k, label, 1 - label, "y"))
    return docs, labels


def frames(spark, docs, labels):
    docs = docs + [(9001, None, "x"), (9002, "", "x"), (9003, " .. ", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(9001, None, None, "y"), (None, 1, 1, "y")], "doc_id long, toxic int, quality int, text string")


def accuracy(rows, labels, at):
    truth = {x[0]: x[at] for x in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def test_toxicity(spark):
    def bad(rng, text):
        for w in ("scum", "Rubbish!"):
            text.insert(rng.randrange(len(text)), w)
        return text

    docs, labels = corpus(600, bad)
    d, lab = frames(spark, docs, labels)
    rows = ftrl.op5(d, lab).collect()
    assert accuracy(rows, labels, 1) > 0.97
    assert len(rows) == len(docs) + 3
    at, weight, _ = ftrl.fit(d, lab)
    assert 0 < len(at) < 4000 and (weight != 0).all()
    assert {r.score for r in ftrl.op5(d, lab.limit(0)).collect()} == {0.5}
    assert ftrl.op5(d.limit(0), lab).count() == 0


def test_quality_needs_no_negative_labels(spark):
    docs, labels = corpus(700, lambda rng, text: [text[0]] * len(text) if rng.random() < 0.5 else [w.upper() + "!!" for w in text])
    d, lab = frames(spark, docs, labels)
    rows = pulearn.op4(d, lab).collect()
    assert accuracy(rows, labels, 2) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    only = lab.where("quality = 1")
    again = {r.doc_id: r.score for r in pulearn.op4(d, only).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)
    assert {r.score for r in pulearn.op4(d, lab.limit(0)).collect()} == {0.5}


def test_prior_is_estimated():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0, 1, (4000, 3)), rng.normal(4, 1, (2000, 3))
    pos, unl = good[:2000], np.concatenate([good[2000:], bad])
    both = np.concatenate([pos, unl])
    assert abs(pulearn.estimate_prior(pos, unl, both.mean(0), both.std(0)) - 0.5) < 0.1


def test_languages(spark):
    rng = random.Random(8)
    parts = {"aa": ["tion", "ment", "able"], "bb": ["stra", "krü", "schl"], "cc": ["ñao", "ezo", "qui"]}
    line = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(k, line(lang, rng.randrange(1, 40)), lang) for k, lang in enumerate(list(parts) * 120)]
    odd = [(900, None, "aa"), (901, "", None), (902, "12 + ²!", "aa"), (903, line("bb", 9), None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.op10(docs).collect()}
    assert np.mean([got[k].lang_pred == lang for k, _, lang in rows if got[k].held_out]) > 0.99
    assert [got[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.op10(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.op10(docs.limit(0)).count() == 0


def test_masks_return_all_languages():
    key = np.arange(5, dtype=np.uint64) * np.uint64(977)
    table = np.zeros((1 << langid.SLOTS, 2), np.uint64)
    for lang in (1, 70):
        for at in langid.slots(key):
            table[at, lang // 64] |= np.uint64(1) << np.uint64(lang % 64)
    masks = np.full((5, 2), ~np.uint64(0))
    for at in langid.slots(key):
        masks &= table[at]
    assert masks.tolist() == [[2, 64]] * 5


def test_learning_equals_a_plain_loop():
    """The vectorised pass against FTRL-proximal written out for one coordinate at a time."""
    rng = random.Random(3)
    rows = [(float(rng.random() < 0.4), np.array(sorted(rng.sample(range(64), rng.randrange(1, 12))), np.int32)) for _ in range(150)]
    z, n, bias, grad = [0.0] * 64, [0.0] * 64, 0.0, 0.0
    l1 = ftrl.L1_ROOT * len(rows) ** 0.5

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - (l1 if z[k] > 0 else -l1)) / ((ftrl.BETA + n[k] ** 0.5) / ftrl.ALPHA + ftrl.L2)

    for _ in range(2):
        for y, at in rows:
            w = {k: weight(k) for k in at.tolist()}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - y
            g *= ftrl.POSITIVE if y else 1.0
            for k in w:
                sigma = ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / ftrl.ALPHA
                z[k] += g - sigma * w[k]
                n[k] += g * g
            grad += g * g
            bias -= 0.1 * g / (1 + grad**0.5)
    weights, own = ftrl.learn(rows, 6, 2)
    assert np.allclose(weights, [weight(k) for k in range(64)]) and abs(own - bias) < 1e-9
    assert (weights != 0).any()


def test_risk_slope_is_the_derivative():
    rng = np.random.default_rng(5)
    loss = lambda g: np.logaddexp(0, -g).mean()
    for shift, prior in ((0.0, 0.3), (-6.0, 0.9)):
        g = np.concatenate([rng.normal(2, 1, 7), rng.normal(shift, 1, 5)])
        bracket = lambda v: loss(-v[7:]) - prior * loss(-v[:7])
        whole = lambda v: prior * loss(v[:7]) + bracket(v)
        goal = whole if bracket(g) >= 0 else lambda v: -bracket(v)
        steps = np.eye(12) * 1e-6
        slope = [(goal(g + e) - goal(g - e)) / 2e-6 for e in steps]
        assert np.allclose(pulearn.risk_slope(g[:7], g[7:], prior), slope, atol=1e-7)
    assert bracket(g) < 0


def test_filters_agree_with_sets(spark):
    """Languages by exact sets of n-grams, one text at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    langs, grams = langid.own_grams(docs)
    sets = {lang: set() for lang in langs}
    for r in grams.collect():
        sets[r.lang].add(r.gram)
    got = {r.doc_id: r for r in langid.op10(docs).collect()}
    checked = 0
    for r in docs.collect():
        line = langid.letters(r.text)
        if not line:
            assert got[r.doc_id].lang_pred == "und"
            continue
        keys = langid.grams(line.split())[0].view(np.int64).tolist()
        shares = sorted(((sum(k in sets[lang] for k in keys) / len(keys), lang) for lang in langs), reverse=True)
        assert abs(got[r.doc_id].score - shares[0][0]) < 0.03
        if shares[0][0] - shares[1][0] > 0.05:
            assert got[r.doc_id].lang_pred == shares[0][1]
            checked += 1
    assert checked > 150


def test_marks_belong_to_words():
    assert langid.letters("हिन्दी भाषा 12, ok²!") == " हिन्दी भाषा ok "
    assert langid.letters("\u0301 12 _") == ""


def test_repeated_rows_and_null_ids_teach_once(spark):
    def bad(rng, text):
        return [*text, "scum", "scum"]

    docs, labels = corpus(300, bad)
    d, lab = frames(spark, docs, labels)
    more = d.unionByName(spark.createDataFrame([docs[0]] * 2000 + [(None, "scum " * 50, "x")] * 500, d.schema))
    long = spark.createDataFrame([(9100, "word " * 400_000 + "scum scum", "x")], d.schema)
    for run in (ftrl.op5, pulearn.op4):
        once = {r.doc_id: r.score for r in run(d, lab).collect()}
        if run is ftrl.op5:
            again = run(more, lab).collect()
            assert len(again) == more.count()
            assert all(abs(once[r.doc_id] - r.score) < 1e-12 for r in again if r.doc_id is not None)
            assert all(r.held_out for r in again if r.doc_id is None)
        assert [0 <= r.score <= 1 for r in run(d.unionByName(long), lab).collect() if r.doc_id == 9100] == [True]
    both = spark.createDataFrame([(k, 1, 1, "y") for k, *_ in docs[:5]], lab.schema)
    assert ftrl.labelled_sample(d, lab.unionByName(both), "toxic", 10_000).where("label = 1").count() >= ftrl.labelled_sample(d, lab, "toxic", 10_000).where("label = 1").count()
