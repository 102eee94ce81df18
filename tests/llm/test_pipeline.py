import random
import re
import zlib

import pytest

import corpus_pipeline
from fragmill.llm import queries
from tests.llm import test_decontam, test_minhash

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside; a user's columns of these names must come through.
CLASHES = ["score", "found", "runs", "n_hit", "n_words", "contaminated", "rep", "uid", "mark", "h", "size", "n", "copies", "share", "curve", "shard", "target", "component_id", "label"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    for k, c in enumerate(CLASHES):
        rows = rows.withColumn(c, rows.doc_id * 100 + k)
    return rows


def intact(rows):
    return all(r[c] == r.doc_id * 100 + k for r in rows for k, c in enumerate(CLASHES))


def test_near_dedup_keeps_what_brute_force_keeps(spark, docs):
    got = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = [i for i, _, comp in test_minhash.brute(texts, 5, 80) if i == comp]
    assert sorted(r.doc_id for r in got) == sorted(want) and intact(got)


def test_decontamination_drops_documents_with_a_passage(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("qxzvk") for _ in range(6))
    filler = [word() for _ in range(5000)]
    passage = test_decontam.words(items[0][1])[:13]
    extra = [(90_001, " ".join(filler[:2500] + passage + filler[2500:])), (90_002, " ".join(filler)), (90_003, " ".join(filler[:2500] + passage[:12] + filler[2500:])), (90_004, None), (90_005, "")]
    more = docs.unionByName(spark.createDataFrame([(i, t, "en", "src0", 0, *[i * 100 + k for k in range(len(CLASHES))]) for i, t in extra], docs.schema))
    got = corpus_pipeline.decontamination(spark, more, SF).collect()
    hit = {r[0] for r in test_decontam.brute([(r.doc_id, r.text) for r in more.select("doc_id", "text").collect()], items) if r[2]}
    assert 90_001 in hit and not hit & {90_002, 90_003, 90_004, 90_005}
    assert {r.doc_id for r in got} == {r.doc_id for r in more.select("doc_id").collect()} - hit and intact(got)


def test_short_items_do_not_empty_the_corpus(spark, tmp_path):
    spark.createDataFrame([(1, "the"), (2, "of the")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "word " * 200 + "of the word"), (2, "the end"), (3, "no such thing")]
    got = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_mixture_meets_the_targets_of_what_is_left(spark, docs):
    got = corpus_pipeline.mixture(spark, docs, SF).collect()
    assert intact(got)
    sizes = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.select("doc_id", "source", "text").collect()}
    totals, taken, most = {}, {}, {}
    for source, n in sizes.values():
        totals[source] = totals.get(source, 0) + n
        most[source] = max(most.get(source, 0), n)
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + sizes[r.doc_id][1]
    from tests.llm.test_mixing import expected_targets

    for source, want in expected_targets(totals).items():
        assert abs(taken.get(source, 0) - want) <= most[source] / 2 + 1e-6


def test_sharding_is_a_cut_of_all_rows(spark, docs):
    got = corpus_pipeline.sharding(spark, docs, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i, len(t) + 8, zlib.crc32(t)) for i, t in texts.items())
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "one two", None, "a", 7), (2, "one two", None, "a", 7), (3, "x " * 3000, "en", None, 1)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
        out = stage(spark, odd, SF)
        n = out.count()
        assert n <= 3 * 6, name
        if name in ("near_dedup", "decontamination", "sharding"):
            assert n == 6, name


def test_stages_chain_and_keep_clean_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.toPandas(), docs.schema)
        counts.append(now.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, sf_dir).select("doc_id").collect()}
    assert all(k in kept for k, toxic in labels.items() if toxic == 0)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == counts[4]
    assert corpus_pipeline.run(spark, sf_dir).exceptAll(out).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_near_dedup_judges_rows_of_one_doc_id_by_their_texts(spark):
    text = lambda w, n=60: " ".join(f"{w}{k}" for k in range(n))
    near = text("c") + " c99"
    rows = [(3, text("a")), (7, text("a")), (7, text("b")), (5, near), (9, text("c")), (9, text("d")), (10, text("d") + " more"), (10, text("e")), (11, None), (12, ""), (None, text("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, None).collect()]
    gone = [(7, text("a")), (9, text("c")), (10, text("d") + " more")]
    assert sorted(kept, key=str) == sorted((r for r in rows if r not in gone), key=str)
