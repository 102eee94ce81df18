"""All registered queries of the retrieval engine over the star, event and document tables, and their SQL twins.

Scores are rounded to six places on both sides, as products of floats depend
on their order.  Queries read whole tables; limits stand only where the
operator is a top-k.  Searches over the graph start from all nodes of a kind
(nations, suppliers), or from customers and parts whose id is divisible by 50.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragmill.functions import text as T
from fragmill.model import Context
from fragmill.operators import combine as C
from fragmill.operators import graph as G
from fragmill.operators import grounding as GR
from fragmill.operators import index as I
from fragmill.operators import measures as M
from fragmill.operators import select as S
from fragmill.operators import structured as X
from fragmill.operators.frag import Frag, eval_unit
from fragmill.operators.units import Annotation, Lexical, Modifier, QueryUnit, evaluate, term_hits, unit_scores
from fragmill.plans import cost, planner
from fragmill.plans import structured as PS
from fragmill.plans.spec import GraphConstraint, QuerySpec
from fragmill.search import lexical_unit, query_terms
from fragmill.session import cut, table
from fragmill.sources import adapters as A
from fragmill.sources import traces as TR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


WORDS = ["thor", "heit", "oner", "the", "als"]
SECOND = ["than", "onen", "re"]
EXPANSION = [("oner", "onor", 0.75, "abbrev", 1), ("als", "ver", 0.5, "subseq", 1), ("heit", "the", 0.75, "prefix", 1), ("than", "heon", 0.9, "prefix", 1)]
UNITS = [QueryUnit("query", (Lexical(WORDS),)), QueryUnit("second", (Lexical(SECOND, weight=0.8, fields=["doc"]), Lexical(["src"], weight=0.4, fields=["container"])), combine="max"), QueryUnit("third", (Lexical(["heit", "oner"]), Lexical(["thor"], weight=0.3)), combine="sum")]


#: Contexts of a session by folder: postings and statistics are built and checkpointed once, like an index that stays open.
_OPEN: dict[tuple[str, str], Context] = {}


def documents(spark: SparkSession, sf_dir: str) -> Context:
    """The documents' index, built at its first use in a session; ``_OPEN.clear()`` after the files of the folder have changed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        expansion = spark.createDataFrame(EXPANSION, "key string, target string, score double, reason string, ord int")
        _OPEN[key] = A.documents_context(spark, sf_dir, expansion).materialized()
    return _OPEN[key]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w3_rank(spark, sf_dir)


# The documents as symbols, postings and statistics, in SQL.
_WORDS_CTE = r"""
dw AS (SELECT doc_id, lower(unnest(ws)) AS term, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{2,}') AS ws FROM documents)),
post0 AS (
  SELECT term, doc_id AS symbol_id, 'name' AS field FROM dw WHERE i <= 5
  UNION ALL SELECT term, doc_id, 'doc' FROM dw WHERE i <= 40
  UNION ALL SELECT * FROM (SELECT unnest(string_split(trim(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(source, ''), '[^A-Za-z]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'))), ' ')) AS term, doc_id, 'container' FROM documents) WHERE term <> ''),
post AS (SELECT term, symbol_id, field, count(*) AS tf FROM post0 GROUP BY term, symbol_id, field),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
terms AS (SELECT term, df, CASE WHEN n > 1 THEN ln(n / df) ELSE 0 END AS icf, CASE WHEN n > 1 THEN ln(n / df) / ln(n) ELSE 0 END AS icf_ratio
          FROM (SELECT term, count(DISTINCT symbol_id) AS df FROM post GROUP BY term), n)"""
_UNITS_CTE = (
    """
probe(unit, satisfier, signal, weight, term, fields) AS (VALUES """
    + ", ".join(f"('{u.name}', {k}, 'lexical', CAST({s.weight} AS DOUBLE), '{t.value}', {'NULL' if f is None else repr(','.join(f))})" for u in UNITS for k, s in enumerate(u.satisfiers) for t, f in s.probes())
    + """),
expansion(key, target, score, reason) AS (VALUES """
    + ", ".join(f"('{k}', '{t}', CAST({s} AS DOUBLE), '{r}')" for k, t, s, r, _ in EXPANSION)
    + """),
surface AS (SELECT *, term AS surface, 1.0 AS sscore, 'exact' AS reason FROM probe UNION ALL SELECT probe.*, target, score, reason FROM probe JOIN expansion ON probe.term = key),
fw(field, w) AS (VALUES ('name', 1.0), ('annotation', 0.9), ('annotation_arg', 0.7), ('modifier', 0.6), ('signature', 0.6), ('container', 0.5), ('doc', 0.3)),
hits AS (
  SELECT p.symbol_id, unit, satisfier, signal, CASE WHEN reason = 'exact' THEN s.term ELSE surface || '←' || s.term || '(' || reason || ')' END AS detail, p.field, weight * sscore * w * icf_ratio AS score
  FROM surface s JOIN terms t ON t.term = surface JOIN post p ON p.term = surface JOIN fw ON fw.field = p.field
  WHERE (reason = 'exact' OR icf_ratio >= 0.34) AND (fields IS NULL OR fields = p.field) AND weight * sscore * w * icf_ratio >= 1e-6),
within AS (SELECT unit, symbol_id, satisfier, 1 - product(1 - least(greatest(score, 0), 1)) AS score FROM hits GROUP BY unit, symbol_id, satisfier),
scores AS (
  SELECT unit, symbol_id, CASE unit WHEN 'query' THEN 1 - product(1 - least(greatest(score, 0), 1)) WHEN 'second' THEN max(score) ELSE sum(score) END AS score, count(*) AS signals
  FROM within GROUP BY unit, symbol_id)"""
)
DOCS = "WITH " + _WORDS_CTE + "\n"
UNITS_SQL = "WITH " + _WORDS_CTE + "," + _UNITS_CTE + "\n"


@query("x2_words", r"SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{2,}')[1:40], lambda x: lower(x)) AS words FROM documents")
def x2_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.words_of("text", 40).alias("words"))


@query("x1_split_parts", r"""SELECT p_partkey, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(p_type || p_brand || ' ' || p_name, '[^A-Za-z]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), ' '), lambda x: x <> '') AS pieces FROM part""")
def x1_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.split_identifier(F.concat("p_type", "p_brand", F.lit(" "), "p_name")).alias("pieces"))


@query("x5_postings", DOCS + "SELECT term, symbol_id, field, tf FROM post")
def x5_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.postings_documents(spark, sf_dir)


_NOTES = r"""
WITH post AS (
  SELECT term, symbol_id, field, count(*) AS tf FROM (
    SELECT '@' || o_orderstatus AS term, o_orderkey AS symbol_id, 'annotation' AS field FROM orders
    UNION ALL SELECT lower(o_orderstatus), o_orderkey, 'annotation' FROM orders
    UNION ALL SELECT 'static', o_orderkey, 'modifier' FROM orders
    UNION ALL SELECT * FROM (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(o_orderpriority), '[^a-z0-9_]+'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')))), o_orderkey, 'annotation_arg' FROM orders)
    UNION ALL SELECT '@' || event_type, event_id + 10000000000, 'annotation' FROM events
    UNION ALL SELECT lower(event_type), event_id + 10000000000, 'annotation' FROM events
    UNION ALL SELECT 'final', event_id + 10000000000, 'modifier' FROM events
    UNION ALL SELECT * FROM (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(props), '[^a-z0-9_]+'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')))), event_id + 10000000000, 'annotation_arg' FROM events))
  GROUP BY term, symbol_id, field),
n AS (SELECT CAST((SELECT count(*) FROM orders) + (SELECT count(*) FROM events) AS DOUBLE) AS n),
terms AS (SELECT term, df, ln(n / df) / ln(n) AS icf_ratio FROM (SELECT term, count(DISTINCT symbol_id) AS df FROM post GROUP BY term), n)
"""


def annotations(spark: SparkSession, sf_dir: str) -> Context:
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("symbol_id")).unionByName(table(spark, sf_dir, "events").select((F.col("event_id") + A.OFFSETS["part"]).alias("symbol_id")))
    return Context(ids, A.postings_annotations(spark, sf_dir))


@query("x6_annotation_postings", _NOTES + "SELECT term, symbol_id, field, tf FROM post")
def x6_annotation_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.postings_annotations(spark, sf_dir)


@query("s1_df", DOCS + "SELECT term, df FROM terms")
def s1_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.frequencies(A.postings_documents(spark, sf_dir))


@query("s2_icf", DOCS + "SELECT term, df, round(icf, 6) AS icf, round(icf_ratio, 6) AS icf_ratio FROM terms")
def s2_icf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).terms.select("term", "df", F.round("icf", 6).alias("icf"), F.round("icf_ratio", 6).alias("icf_ratio"))


@query("s10_vocabulary", DOCS + "SELECT term, df FROM terms ORDER BY df DESC, term LIMIT 1200")
def s10_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.vocabulary(documents(spark, sf_dir).terms, 1200)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("symbol_id", "unit", "detail", "field", F.round("score", 6).alias("score"))


_HITS = "symbol_id, unit, detail, field, round(score, 6) AS score"


@query("q1_lexical_hits", UNITS_SQL + f"SELECT {_HITS} FROM hits WHERE unit = 'query'")
def q1_lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(term_hits(UNITS[:1], documents(spark, sf_dir)))


@query("q1_field_restricted", UNITS_SQL + f"SELECT {_HITS} FROM hits WHERE unit = 'second'")
def q1_field_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(term_hits(UNITS[1:2], documents(spark, sf_dir)))


@query("f7_icf_floor", UNITS_SQL + "SELECT DISTINCT s.term, surface, reason FROM surface s JOIN terms t ON t.term = surface WHERE reason = 'exact' OR icf_ratio >= 0.34")
def f7_icf_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.operators.units import surfaces

    ctx = documents(spark, sf_dir)
    looked = surfaces(UNITS, ctx)
    kept = ctx.terms.withColumnRenamed("term", "t").join(F.broadcast(looked), F.col("t") == F.col("surface"))
    return kept.where((F.col("reason") == "exact") | (F.col("icf_ratio") >= ctx.icf_floor)).select("term", "surface", "reason").distinct()


@query("q2_annotation_hits", _NOTES + """SELECT symbol_id, 'q' AS unit, p.term AS detail, field, round(0.9 * CASE field WHEN 'annotation' THEN 0.9 ELSE 0.7 END * icf_ratio, 6) AS score
FROM post p JOIN terms USING (term) WHERE field IN ('annotation', 'annotation_arg') AND term IN ('@error', 'urgent', 'medium', '@F')""")
def q2_annotation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(term_hits([QueryUnit("q", (Annotation(["@error", "@F"], ["urgent", "medium"]),))], annotations(spark, sf_dir)))


@query("q3_modifier_hits", _NOTES + "SELECT symbol_id, 'q' AS unit, p.term AS detail, field, round(0.6 * 0.6 * icf_ratio, 6) AS score FROM post p JOIN terms USING (term) WHERE field = 'modifier' AND term IN ('static', 'final')")
def q3_modifier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(term_hits([QueryUnit("q", (Modifier(["Static", "FINAL"]),))], annotations(spark, sf_dir)))


_COMBINE = "SELECT o_custkey AS k, round({}, 6) AS score FROM orders GROUP BY o_custkey"


def _combined(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = F.col("o_totalprice") % 1
        return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(C.combine(name, part), 6).alias("score"))

    return run


for _name, _sql in (("noisy_or", "1 - product(1 - o_totalprice % 1)"), ("max", "max(o_totalprice % 1)"), ("sum", "sum(o_totalprice % 1)")):
    query(f"s4_{_name}", _COMBINE.format(_sql))(_combined(_name))


@query("s5_unit_scores", UNITS_SQL + "SELECT unit, symbol_id, round(score, 6) AS score, signals FROM scores")
def s5_unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_scores(term_hits(UNITS, documents(spark, sf_dir)), UNITS).select("unit", "symbol_id", F.round("score", 6).alias("score"), "signals")


def working_set(ctx: Context) -> Frag:
    """All units' evidence as one fragment, in one pass."""
    hits = cut(evaluate(UNITS, ctx))
    return Frag.of(ctx.symbols.join(hits.select("symbol_id").distinct(), "symbol_id", "left_semi"), hits=hits)


@query("s6_scores", UNITS_SQL + "SELECT symbol_id, unit, round(score, 6) AS score FROM scores")
def s6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return working_set(documents(spark, sf_dir)).scores().select("symbol_id", "unit", F.round("score", 6).alias("score"))


@query("s7_score_of", UNITS_SQL + "SELECT symbol_id, round(sum(score), 6) AS score FROM scores GROUP BY symbol_id")
def s7_score_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return working_set(documents(spark, sf_dir)).score().select("symbol_id", F.round("score", 6).alias("score"))


_TOTAL = UNITS_SQL.rstrip() + ",\ntotal AS (SELECT symbol_id, sum(score) AS score FROM scores GROUP BY symbol_id)\n"


@query("w1_top", _TOTAL + "SELECT symbol_id, round(score, 6) AS score FROM total ORDER BY round(total.score, 9) DESC, symbol_id LIMIT 20")
def w1_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_ids(working_set(documents(spark, sf_dir)).score(), 20).select("symbol_id", F.round("score", 6).alias("score"))


@query("w1_top_by_unit", UNITS_SQL + "SELECT symbol_id, round(coalesce(s, 0), 6) AS score FROM (SELECT DISTINCT symbol_id FROM scores) LEFT JOIN (SELECT symbol_id, score AS s FROM scores WHERE unit = 'third') USING (symbol_id) ORDER BY round(coalesce(s, 0), 9) DESC, symbol_id LIMIT 20")
def w1_top_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_ids(working_set(documents(spark, sf_dir)).score("third"), 20).select("symbol_id", F.round("score", 6).alias("score"))


@query("w2_boosted_top", _TOTAL + """, b AS (SELECT symbol_id, score * (1 + 0.6 * CASE WHEN symbol_id % 3 = 0 THEN 1 ELSE 0 END) * (1 + 0.3 * CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE 0 END) AS score FROM total JOIN documents ON doc_id = symbol_id)
SELECT symbol_id, round(score, 6) AS score FROM b ORDER BY round(b.score, 9) DESC, symbol_id LIMIT 25""")
def w2_boosted_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    frag = working_set(documents(spark, sf_dir))
    boosted = S.boosted_scores(frag, frag.nodes.select("symbol_id").where("symbol_id % 3 = 0"), ["src1", "src2"])
    return S.top_ids(boosted, 25).select("symbol_id", F.round("score", 6).alias("score"))


@query("w3_rank", _TOTAL + """, best AS (SELECT symbol_id, score FROM total ORDER BY round(score, 9) DESC, symbol_id LIMIT 30),
why AS (SELECT symbol_id, string_agg(detail || '@' || field, ', ' ORDER BY r) AS why FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY round(score, 9) DESC, detail, field) AS r FROM hits) WHERE r <= 3 GROUP BY symbol_id)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, symbol_id) AS rank, symbol_id, source AS kind, round(score, 4) AS score, why FROM best JOIN documents ON doc_id = symbol_id JOIN why USING (symbol_id)""")
def w3_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    frag = working_set(documents(spark, sf_dir))
    return S.ranked(frag, 30).join(S.reasons(frag), "symbol_id").select("rank", "symbol_id", "kind", "score", "why")


@query("w4_why", UNITS_SQL + "SELECT symbol_id, string_agg(detail || '@' || field, ', ' ORDER BY r) AS why FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY round(score, 9) DESC, detail, field) AS r FROM hits) WHERE r <= 3 GROUP BY symbol_id")
def w4_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reasons(working_set(documents(spark, sf_dir)))


def parts(spark: SparkSession, sf_dir: str) -> Frag:
    return Frag.of(A.symbols_parts(spark, sf_dir))


@query("f1_only_kind", "SELECT p_partkey AS symbol_id, p_name AS name FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_brand = 'Brand#2' AND p_size > 10")
def f1_only_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.only(parts(spark, sf_dir), kind=["PROMO", "SMALL"], file="Brand#2", where=F.col("size") > 10).nodes.select("symbol_id", "name")


@query("f1_only_empty", "SELECT p_partkey AS symbol_id FROM part WHERE false")
def f1_only_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.only(parts(spark, sf_dir), kind=[]).nodes.select("symbol_id")


_EDGES = """WITH e AS (
  SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(1000 + n_nationkey AS BIGINT) AS dst, 'contains' AS kind, 1.0::DOUBLE AS confidence, 'derived_container' AS provenance FROM nation
  UNION ALL SELECT 1000 + s_nationkey, 10000 + s_suppkey, 'contains', 1.0, 'derived_container' FROM supplier
  UNION ALL SELECT 1000 + c_nationkey, 1000000 + c_custkey, 'contains', 1.0, 'derived_container' FROM customer
  UNION ALL SELECT 1000000 + o_custkey, 100000000 + o_orderkey, 'calls', 1.0, 'typed_receiver' FROM orders
  UNION ALL SELECT 100000000 + l_orderkey, 10000000000 + l_partkey, 'calls', 1 - l_discount, CASE WHEN l_returnflag = 'N' THEN 'typed_receiver' ELSE 'name_match' END FROM lineitem),
node AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, 'region' AS kind FROM region UNION ALL SELECT 1000 + n_nationkey, 'nation' FROM nation UNION ALL SELECT 10000 + s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT 1000000 + c_custkey, 'customer' FROM customer UNION ALL SELECT 100000000 + o_orderkey, 'order' FROM orders UNION ALL SELECT 10000000000 + p_partkey, 'part' FROM part)
"""


@query("a9_edges", _EDGES + "SELECT src, dst, kind, round(confidence, 6) AS confidence, provenance FROM e")
def a9_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.edges_star(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query("f9_edge_filter", _EDGES + "SELECT kind, provenance, count(*) AS n FROM e WHERE kind IN ('calls') AND confidence >= 0.95 GROUP BY kind, provenance")
def f9_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.edges_star(spark, sf_dir).where("kind IN ('calls') AND confidence >= 0.95").groupBy("kind", "provenance").agg(F.count("*").alias("n"))


def _star(spark: SparkSession, sf_dir: str) -> tuple[Context, Frag]:
    ctx = A.star_context(spark, sf_dir)
    return ctx, Frag.of(ctx.symbols)


@query("f2_degree_in", _EDGES + "SELECT id AS symbol_id FROM node JOIN (SELECT dst, count(*) AS n FROM e WHERE kind = 'calls' GROUP BY dst) ON dst = id WHERE n >= 35")
def f2_degree_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, frag = _star(spark, sf_dir)
    return S.degree(frag, ctx, min_in=35).nodes.select("symbol_id")


@query("f2_degree_out_range", _EDGES + "SELECT id AS symbol_id FROM node LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) ON src = id WHERE coalesce(n, 0) BETWEEN 6 AND 9")
def f2_degree_out_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, frag = _star(spark, sf_dir)
    return S.degree(frag, ctx, edge=None, min_out=6, max_out=9).nodes.select("symbol_id")


def _part_frag(spark: SparkSession, sf_dir: str) -> Frag:
    ctx, _ = _star(spark, sf_dir)
    return Frag.of(ctx.symbols, ctx.edge_table.where("kind = 'contains'"))


_CONTAINS = _EDGES.rstrip() + ", c AS (SELECT * FROM e WHERE kind = 'contains')\n"


@query("f4_roots", _CONTAINS + "SELECT id AS symbol_id, kind FROM node WHERE id NOT IN (SELECT dst FROM c)")
def f4_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_frag(spark, sf_dir).roots().nodes.select("symbol_id", "kind")


@query("f4_leaves", _CONTAINS + "SELECT id AS symbol_id, kind FROM node WHERE id NOT IN (SELECT src FROM c)")
def f4_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_frag(spark, sf_dir).leaves().nodes.select("symbol_id", "kind")


@query("f3_induced_edges", _CONTAINS + "SELECT src, dst FROM c WHERE src % 2 = 0 AND dst % 2 = 0")
def f3_induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    frag = _part_frag(spark, sf_dir)
    return frag.induced(frag.nodes.select("symbol_id").where("symbol_id % 2 = 0")).edges.select("src", "dst")


def _two(spark: SparkSession, sf_dir: str) -> tuple[Frag, Frag]:
    ctx = documents(spark, sf_dir)
    return eval_unit(UNITS[0], ctx), eval_unit(UNITS[1], ctx)


def _evidence(frag: Frag) -> DataFrame:
    return frag.hits.where("signal <> 'combined'").groupBy("symbol_id").agg(F.count("*").alias("hits"), F.round(F.sum("score"), 6).alias("score"))


_A = "(SELECT symbol_id FROM hits WHERE unit = 'query')"
_B = "(SELECT symbol_id FROM hits WHERE unit = 'second')"
_EVIDENCE = "SELECT symbol_id, count(*) AS hits, round(sum(score), 6) AS score FROM (SELECT DISTINCT symbol_id, unit, satisfier, detail, field, score FROM hits WHERE unit IN ({})) WHERE {} GROUP BY symbol_id"


@query("u1_union", UNITS_SQL + _EVIDENCE.format("'query', 'second'", "true"))
def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return _evidence(a | b)


@query("u2_intersect", UNITS_SQL + _EVIDENCE.format("'query', 'second'", f"symbol_id IN {_A} AND symbol_id IN {_B}"))
def u2_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return _evidence(a & b)


@query("u3_difference", UNITS_SQL + _EVIDENCE.format("'second'", f"symbol_id NOT IN {_A}"))
def u3_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return _evidence(b - a)


def _reach(direction: str, hops: tuple[int, int], seeds: str, edge: object = ("calls", "contains"), confidence: float = 0.0) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx, frag = _star(spark, sf_dir)
        start = Frag.of(frag.nodes.where(seeds))
        return G.reach(start, ctx, edge=edge, direction=direction, hops=hops, min_confidence=confidence).nodes.select("symbol_id", "kind")

    return run


def _reach_sql(step: str, hops: tuple[int, int], seeds: str, where: str) -> str:
    low, high = hops
    sql = _EDGES.rstrip() + f", s AS (SELECT DISTINCT * FROM ({step.format(where=where)})), d0 AS (SELECT id, 0 AS d FROM node WHERE {seeds})"
    for k in range(1, high + 1):
        sql += f", d{k} AS (SELECT DISTINCT s.b AS id, {k} AS d FROM d{k - 1} JOIN s ON s.a = d{k - 1}.id)"
    union = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(high + 1))
    return sql + f" SELECT node.id AS symbol_id, kind FROM node JOIN (SELECT id, min(d) AS d FROM ({union}) GROUP BY id) USING (id) WHERE d BETWEEN {low} AND {high}"


_FWD, _BACK = "SELECT src AS a, dst AS b FROM e WHERE {where}", "SELECT dst AS a, src AS b FROM e WHERE {where}"
for _name, _direction, _hops, _seeds, _kinds, _conf in (
    ("g1_reach_fwd", "forward", (1, 3), "kind = 'nation'", ("calls", "contains"), 0.0),
    ("g1_reach_back", "backward", (2, 3), "kind = 'part' AND {id} % 50 = 0", ("calls", "contains"), 0.0),
    ("g1_reach_any", "any", (1, 2), "kind = 'supplier'", None, 0.0),
    ("g1_reach_confidence", "forward", (0, 1), "kind = 'order' AND {id} % 50 = 0", "calls", 0.95),
):
    _where = ("true" if _kinds is None else f"kind IN ({', '.join(repr(k) for k in ([_kinds] if isinstance(_kinds, str) else _kinds))})") + f" AND confidence >= {_conf}"
    _step = {"forward": _FWD, "backward": _BACK, "any": _FWD + " UNION ALL " + _BACK}[_direction]
    query(_name, _reach_sql(_step, _hops, _seeds.format(id="id"), _where))(_reach(_direction, _hops, _seeds.format(id="symbol_id"), _kinds, _conf))


def _paths(**options: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx, frag = _star(spark, sf_dir)
        src, dst = frag.nodes.where("kind = 'customer' AND symbol_id % 50 = 0"), frag.nodes.where("kind = 'part'")
        own = dict(options)
        for side in ("via", "avoid"):
            if side in own:
                own[side] = frag.nodes.where(own[side])
        out = G.paths_between(src, dst, ctx.edge_table, max_paths=None, **own)
        return out.select(F.array_join("nodes", ">").alias("path"))

    return run


_PATH = _EDGES.rstrip() + """, s AS (SELECT DISTINCT src, dst FROM e WHERE kind = 'calls'), deg AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e WHERE kind = 'calls' UNION ALL SELECT dst FROM e WHERE kind = 'calls') GROUP BY id)
SELECT a.src || '>' || a.dst || '>' || b.dst AS path FROM s a JOIN s b ON a.dst = b.src WHERE a.src BETWEEN 1000000 AND 99999999 AND a.src % 50 = 0 AND b.dst >= 10000000000 """
query("g2_hop_paths", _PATH)(_paths(hops=(1, 3), max_degree=None))
query("g2_hop_exact2", _PATH)(_paths(hops=2, max_degree=None))
query("g2_hop_avoid", _PATH + "AND a.dst % 2 <> 0")(_paths(hops=(1, 2), max_degree=None, avoid="kind = 'order' AND symbol_id % 2 = 0"))
query("g2_hop_via", _PATH + "AND a.dst % 3 = 0")(_paths(hops=(1, 2), max_degree=None, via="kind = 'order' AND symbol_id % 3 = 0"))
query("g2_hop_hub", _PATH + "AND a.dst NOT IN (SELECT id FROM deg WHERE n > 5)")(_paths(hops=(1, 2), max_degree=5))


_QUALIFIED = """WITH s AS (SELECT p_partkey AS symbol_id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN '' ELSE (SELECT min(p_name) FROM part) END AS container FROM part),
o AS (SELECT CASE WHEN container = '' THEN name ELSE container || '.' || name END AS owner, min(symbol_id) AS src FROM s GROUP BY 1)
"""


@query("g5_contains", _QUALIFIED + "SELECT src, symbol_id AS dst, 'contains' AS kind, 1.0::DOUBLE AS confidence FROM s JOIN o ON s.container = o.owner WHERE container <> '' AND src <> symbol_id")
def g5_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    least = p.agg(F.min("p_name")).first()[0]
    symbols = p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "").otherwise(least).alias("container"))
    return G.contains_edges(symbols).select("src", "dst", "kind", "confidence")


@query("j9_contains", """SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(1000 + n_nationkey AS BIGINT) AS dst, 'contains' AS kind, 1.0::DOUBLE AS confidence, 'derived_container' AS provenance FROM nation
UNION ALL SELECT 1000 + s_nationkey, 10000 + s_suppkey, 'contains', 1.0, 'derived_container' FROM supplier""")
def j9_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment found again from qualified names alone: regions hold nations hold suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    regions, nations = t("region"), t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda i, name, container: [i.cast("long").alias("symbol_id"), name.alias("name"), container.alias("container")]
    symbols = regions.select(*row(F.col("r_regionkey"), F.col("r_name"), F.lit("")))
    symbols = symbols.unionByName(nations.select(*row(1000 + F.col("n_nationkey"), F.col("n_name"), F.col("r_name"))))
    held = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return G.contains_edges(symbols.unionByName(held.select(*row(10000 + F.col("s_suppkey"), F.col("s_name"), F.concat_ws(".", "r_name", "n_name")))))


@query("j12_impl_pairs", """WITH p AS (SELECT DISTINCT o_custkey AS abstract, o_orderkey AS impl FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT abstract, impl, c_name AS abstract_name, o_orderstatus AS impl_name, count(*) OVER (PARTITION BY abstract) = 1 AS "unique" FROM p JOIN customer ON c_custkey = abstract JOIN orders ON o_orderkey = impl""")
def j12_impl_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as abstract symbols, their urgent orders as implementations."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    off = 10_000_000_000
    names = c.select(F.col("c_custkey").cast("long").alias("symbol_id"), F.col("c_name").alias("name")).unionByName(o.select((F.col("o_orderkey") + off).alias("symbol_id"), F.col("o_orderstatus").alias("name")))
    pairs = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("long").alias("abstract"), (F.col("o_orderkey") + off).alias("impl"))
    return G.implementation_pairs(pairs, names).withColumn("impl", F.col("impl") - off)


@query("g10_callees", _EDGES + """SELECT id AS symbol_id FROM node WHERE kind = 'order' AND id IN (SELECT dst FROM e WHERE kind = 'calls' AND src IN (SELECT 1000000 + c_custkey FROM customer WHERE c_name IN ('Customer#000000001', 'Customer#000000004', 'Customer#000000010')))""")
def g10_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, frag = _star(spark, sf_dir)
    entries = [("customer", "Customer#000000001"), (None, "Customer#000000004"), (None, "Customer#000000010")]
    return G.call_filter(frag.nodes.where("kind = 'order'"), entries, ctx.symbols, ctx.edge_table.where("kind = 'calls'")).select("symbol_id")


@query("g10_callers", _EDGES + """, c AS (SELECT src, dst FROM e WHERE kind = 'calls'), one AS (SELECT src AS id FROM c WHERE dst IN (SELECT 10000000000 + p_partkey FROM part WHERE p_name = (SELECT min(p_name) FROM part)))
SELECT id AS symbol_id FROM node WHERE kind = 'customer' AND id IN (SELECT src FROM c WHERE dst IN (SELECT id FROM one))""")
def g10_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within two calls of a part of the first name."""
    ctx, frag = _star(spark, sf_dir)
    first = table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0]
    return G.call_filter(frag.nodes.where("kind = 'customer'"), [("part", first)], ctx.symbols, ctx.edge_table.where("kind = 'calls'"), role="callee", layer=2).select("symbol_id")


@query("g6_call_confidence", """WITH m AS (SELECT p_partkey AS symbol_id, p_brand AS owner, p_name AS name FROM part), up(type, parent) AS (SELECT DISTINCT p_brand, 'Brand#' || (1 + (CAST(substring(p_brand, 7) AS INTEGER) % 5)) FROM part),
c AS (SELECT DISTINCT p_partkey AS src, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS rt FROM part),
w AS (SELECT src, name, rt, rt AS type, 0 AS d FROM c WHERE rt IS NOT NULL UNION ALL SELECT src, name, rt, u.parent, 1 FROM c JOIN up u ON rt = u.type
  UNION ALL SELECT src, name, rt, v.parent, 2 FROM c JOIN up u ON rt = u.type JOIN up v ON u.parent = v.type UNION ALL SELECT src, name, rt, x.parent, 3 FROM c JOIN up u ON rt = u.type JOIN up v ON u.parent = v.type JOIN up x ON v.parent = x.type),
f AS (SELECT w.src, w.name, w.rt, d, symbol_id FROM w JOIN m ON w.type = m.owner AND w.name = m.name),
t AS (SELECT DISTINCT src, name, rt, symbol_id FROM f QUALIFY d = min(d) OVER (PARTITION BY src, name, rt)),
tn AS (SELECT *, count(*) OVER (PARTITION BY src, name, rt) AS n FROM t),
r AS (SELECT c.src, symbol_id, count(*) OVER (PARTITION BY c.src, c.name, c.rt) AS n FROM c JOIN m USING (name) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.src = c.src AND t.name = c.name AND t.rt IS NOT DISTINCT FROM c.rt))
SELECT src, symbol_id AS dst, round(0.9 / n, 4) AS confidence, 'typed_receiver' AS provenance FROM tn WHERE src <> symbol_id
UNION ALL SELECT src, symbol_id, round(0.6 / n, 4), 'name_match' FROM r WHERE n <= 40 AND src <> symbol_id""")
def g6_call_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.call_edges(*_part_calls(spark, sf_dir), most=40).select("src", "dst", "confidence", "provenance")


def _part_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    calls = p.select(F.col("p_partkey").alias("src"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("receiver_type"))
    members = p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("owner"), F.col("p_name").alias("name"))
    parent = F.concat(F.lit("Brand#"), (1 + F.substr("p_brand", F.lit(7)).cast("int") % 5).cast("string"))
    up = p.select(F.col("p_brand").alias("type"), parent.alias("parent")).distinct()
    return calls, members, up


@query("s18_call_outcomes", ORACLE["g6_call_confidence"].split("tn AS (")[0].rstrip().removesuffix(",") + """
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.src = c.src AND t.name = c.name AND t.rt IS NOT DISTINCT FROM c.rt) THEN 'typed' WHEN k <= 8 THEN 'named' WHEN k > 8 THEN 'ambiguous' ELSE 'unresolved' END AS outcome FROM c LEFT JOIN (SELECT name, count(DISTINCT symbol_id) AS k FROM m GROUP BY name) USING (name)) GROUP BY outcome""")
def s18_call_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.call_outcomes(*_part_calls(spark, sf_dir))


@query("j8_range_match", """WITH pt AS (SELECT event_id AS point, event_type AS file, CAST(floor(value) AS INTEGER) AS line FROM events),
rg AS (SELECT event_id AS range_id, event_type AS file, CAST(user_id % 80 AS INTEGER) AS s, CAST(user_id % 80 + event_id % 37 AS INTEGER) AS t FROM events),
j AS (SELECT point, range_id, t - s AS w FROM pt JOIN rg USING (file) WHERE s <= line AND line <= t)
SELECT point, min(range_id) AS range_id FROM (SELECT *, min(w) OVER (PARTITION BY point) AS m FROM j) WHERE w = m GROUP BY point HAVING count(*) = 1""")
def j8_range_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    points = e.select(F.col("event_id").alias("point"), F.col("event_type").alias("file"), F.floor("value").cast("int").alias("line"))
    start = (F.col("user_id") % 80).cast("int")
    ranges = e.select(F.col("event_id").alias("range_id"), F.col("event_type").alias("file"), start.alias("start"), (start + F.col("event_id") % 37).cast("int").alias("end"))
    return G.tightest_enclosing(points, ranges)


@query("j11_impl_resolution", """WITH p AS (SELECT DISTINCT o_custkey AS abstract, o_orderkey AS impl FROM orders), k AS (SELECT abstract, count(*) AS n, min(impl) AS impl FROM p GROUP BY abstract)
SELECT o_orderkey AS src, o_custkey AS dst, CASE WHEN n = 1 THEN impl END AS impl, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how FROM orders LEFT JOIN k ON abstract = o_custkey""")
def j11_impl_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return G.implementations(o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")), o.select(F.col("o_custkey").alias("abstract"), F.col("o_orderkey").alias("impl")))


@query("j13_pairs_within_n", _EDGES + """, s AS (SELECT src AS a, dst AS b FROM e WHERE kind <> 'x' UNION SELECT dst, src FROM e), l AS (SELECT id FROM node WHERE kind = 'supplier'), r AS (SELECT id FROM node WHERE kind IN ('supplier', 'region', 'nation'))
SELECT a, b, min(h) AS hops FROM (
  SELECT l.id AS a, l.id AS b, 0 AS h FROM l UNION ALL SELECT l.id, s.b, 1 FROM l JOIN s ON s.a = l.id UNION ALL SELECT DISTINCT l.id, t.b, 2 FROM l JOIN s ON s.a = l.id JOIN s t ON t.a = s.b) WHERE b IN (SELECT id FROM r) GROUP BY a, b""")
def j13_pairs_within_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, frag = _star(spark, sf_dir)
    return G.pairs_within(frag.nodes.where("kind = 'supplier'"), frag.nodes.where("kind IN ('supplier', 'region', 'nation')"), ctx.edge_table, 2)


@query("f15_graph_roles", _EDGES + """SELECT id AS symbol_id, CASE WHEN coalesce(i, 0) = 0 AND coalesce(o, 0) > 0 THEN 'entry_point' WHEN coalesce(i, 0) > 0 AND coalesce(o, 0) = 0 THEN 'leaf' WHEN coalesce(i, 0) = 0 THEN 'isolate' ELSE 'inner' END AS role
FROM node LEFT JOIN (SELECT src, count(*) AS o FROM e WHERE kind = 'calls' GROUP BY src) ON src = id LEFT JOIN (SELECT dst, count(*) AS i FROM e WHERE kind = 'calls' GROUP BY dst) ON dst = id""")
def f15_graph_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, _ = _star(spark, sf_dir)
    return G.graph_roles(ctx.symbols, ctx.edge_table.where("kind = 'calls'"))


@query("g9_directed_reach", _EDGES + """, s AS (SELECT DISTINCT src, dst FROM e WHERE kind = 'calls'), d1 AS (SELECT DISTINCT dst AS id FROM s WHERE src % 50 = 0 AND src < 100000000)
SELECT id AS symbol_id, min(d) AS depth FROM (SELECT id, 1 AS d FROM d1 UNION ALL SELECT dst, 2 FROM s WHERE src IN (SELECT id FROM d1)) GROUP BY id""")
def g9_directed_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, frag = _star(spark, sf_dir)
    return G.directed_reach(frag.nodes.where("kind = 'customer' AND symbol_id % 50 = 0"), ctx.edge_table.where("kind = 'calls'"))


@query("g7_cohere", _EDGES + """, w AS (SELECT p_partkey + 10000000000 AS id, p_size / 50.0 AS score FROM part), seed AS (SELECT id FROM w ORDER BY score DESC, id LIMIT 20),
s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), d1 AS (SELECT DISTINCT b AS id FROM s WHERE a IN (SELECT id FROM seed)), d2 AS (SELECT DISTINCT b AS id FROM s WHERE a IN (SELECT id FROM d1))
SELECT id AS symbol_id FROM w WHERE id IN (SELECT id FROM d1 UNION SELECT id FROM d2) AND id NOT IN (SELECT id FROM seed)""")
def g7_cohere(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, _ = _star(spark, sf_dir)
    scores = table(spark, sf_dir, "part").select((F.col("p_partkey") + A.OFFSETS["part"]).alias("symbol_id"), (F.col("p_size") / 50.0).alias("score"))
    seeds = Frag.of(S.top_ids(scores, 20))
    return G.reach(seeds, ctx, edge=["calls", "contains"], direction="any", hops=(1, 2)).nodes.join(scores, "symbol_id", "left_semi").select("symbol_id")


@query("s8_kind_share", DOCS + "SELECT kind, round(share, 6) AS share FROM (SELECT source AS kind, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM post JOIN documents ON doc_id = symbol_id WHERE term IN ('thor', 'heit', 'oner') GROUP BY source) WHERE share >= 0.05")
def s8_kind_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = documents(spark, sf_dir)
    return M.kind_shares(ctx, ["thor", "heit", "oner"], least=0.05).select("kind", F.round("share", 6).alias("share"))


@query("s9_field_share", DOCS + "SELECT field, round(share, 6) AS share FROM (SELECT field, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM post WHERE term IN ('thor', 'heit', 'oner') GROUP BY field) WHERE share >= 0.15")
def s9_field_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.field_shares(documents(spark, sf_dir), ["thor", "heit", "oner"]).select("field", F.round("share", 6).alias("share"))


@query("s11_avg_degree", _EDGES + """, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), f AS (SELECT id FROM node ORDER BY id LIMIT 200)
SELECT round(greatest(avg(coalesce(n, 0)), 1.0), 6) AS average FROM f LEFT JOIN d USING (id)""")
def s11_avg_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, _ = _star(spark, sf_dir)
    return cost.average_degree_frame(ctx).select(F.round("average", 6).alias("average"))


@query("s12_edge_estimate", _EDGES + """, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), f AS (SELECT id FROM node ORDER BY id LIMIT 300)
SELECT CAST(floor(sum(coalesce(n, 0)) * CAST((SELECT count(*) FROM node) AS DOUBLE) / count(*)) AS BIGINT) AS estimate FROM f LEFT JOIN d USING (id)""")
def s12_edge_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, _ = _star(spark, sf_dir)
    return cost.edge_estimate(ctx)


@query("s13_lift", _EDGES + """, a AS (SELECT id FROM node WHERE kind = 'nation'), b AS (SELECT id FROM node WHERE kind IN ('supplier', 'part')),
x AS (SELECT count(*) AS n FROM (SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT id FROM a) AND dst IN (SELECT id FROM b) UNION SELECT DISTINCT dst, src FROM e WHERE dst IN (SELECT id FROM a) AND src IN (SELECT id FROM b)))
SELECT round(x.n * 1.0 / ((SELECT count(*) FROM a) * 1.0 * (SELECT count(*) FROM b) * 2.0 * (SELECT count(*) FROM e) / ((SELECT count(*) FROM node) * 1.0 * (SELECT count(*) FROM node))), 6) AS lift FROM x""")
def s13_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, frag = _star(spark, sf_dir)
    return M.lift(ctx, frag.nodes.where("kind = 'nation'"), frag.nodes.where("kind IN ('supplier', 'part')")).select(F.round("lift", 6).alias("lift"))


_JACCARD = DOCS.rstrip() + ", ps AS (SELECT DISTINCT term, symbol_id FROM post WHERE term IN ('thor', 'heit', 'oner', 'than', 'mit')), df AS (SELECT term, count(*) AS n FROM ps GROUP BY term)\n"


@query("s14_cohesion", _JACCARD + "SELECT a.term AS a, b.term AS b, round(count(p.symbol_id) * 1.0 / (a.n + b.n - count(p.symbol_id)), 6) AS jaccard FROM df a JOIN df b ON a.term < b.term LEFT JOIN (SELECT x.term AS t, y.term AS u, x.symbol_id FROM ps x JOIN ps y USING (symbol_id)) p ON p.t = a.term AND p.u = b.term GROUP BY a.term, b.term, a.n, b.n")
def s14_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.jaccards(documents(spark, sf_dir), ["thor", "heit", "oner", "than", "mit"]).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("p3_estimates", UNITS_SQL + """SELECT unit, CAST(round(n * (1 - coalesce(product(1 - least(df / n, 1)), 1))) AS BIGINT) AS "rows", CAST(coalesce(sum(np), 0) AS BIGINT) AS cost FROM surface s JOIN terms t ON t.term = surface JOIN (SELECT term, count(*) AS np FROM post GROUP BY term) q ON q.term = surface, n GROUP BY unit, n""")
def p3_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.estimates(UNITS, documents(spark, sf_dir))


@query("p4_plan_order")
def p4_plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = planner.plan(QuerySpec(units=tuple(UNITS), graph=(GraphConstraint("query", "second"),), kinds=("src1",), limit=25), documents(spark, sf_dir))
    return spark.createDataFrame([(k, s.label) for k, s in enumerate(plan.steps)], "step int, label string")


@query("p6_plan_run")
def p6_plan_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = documents(spark, sf_dir)
    plan = planner.plan(QuerySpec(units=tuple(UNITS[:2]), limit=30), ctx)
    return S.ranked(plan.run(ctx).current, 30)


_RANK = "SELECT row_number() OVER (ORDER BY round(score, 9) DESC, symbol_id) AS rank, symbol_id, source AS kind, round(score, 4) AS score FROM {} JOIN documents ON doc_id = symbol_id ORDER BY round({}.score, 9) DESC, symbol_id LIMIT {}"
_OR = "1 - product(1 - least(greatest(score, 0), 1))"


@query("p9_search_lexical", UNITS_SQL.rstrip() + f",\nx AS (SELECT symbol_id, {_OR} AS score FROM hits WHERE unit = 'query' AND detail <> 'the' GROUP BY symbol_id)\n" + _RANK.format("x", "x", 20))
def p9_search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = documents(spark, sf_dir)
    frag = eval_unit(lexical_unit(query_terms("Where is the THOR of heit, with oner and als?", ctx)), ctx)
    return S.ranked(frag, 20).select("rank", "symbol_id", "kind", "score")


_VOCAB = DOCS.rstrip() + ", v AS (SELECT term FROM terms WHERE regexp_full_match(term, '[a-z]+')), d AS (SELECT term FROM terms WHERE df >= 2 AND length(term) >= 3 AND icf_ratio >= 0.34 AND regexp_full_match(term, '[a-z]+'))\n"


def _vocabulary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ctx = documents(spark, sf_dir)
    words = ctx.terms.where(F.col("term").rlike("^[a-z]+$"))
    return words.select(F.col("term").alias("word")), GR.discriminating(words, ctx.total)


#: The vocabularies of whole texts by session and folder, as (terms with icf, number of documents).
_WHOLE: dict[tuple[str, str], tuple[DataFrame, int]] = {}


def _whole_vocabulary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``_vocabulary`` over all words of all texts; frequencies alone are kept, so nothing grows with the postings."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WHOLE:
        total = table(spark, sf_dir, "documents").count()
        _WHOLE[key] = I.with_icf(cut(A.frequencies_documents(spark, sf_dir)), total), total
    terms, total = _WHOLE[key]
    words = terms.where(F.col("term").rlike("^[a-z]+$"))
    return words.select(F.col("term").alias("word")), GR.discriminating(words, total)


_SKELETON = "substring(term, 1, 1) || array_to_string(list_filter(regexp_extract_all(substring(term, 2), '[^aeiou]'), lambda x, i: i = 1 OR x <> regexp_extract_all(substring(term, 2), '[^aeiou]')[i - 1]), '')"


@query("x8_skeleton", _VOCAB + f"SELECT term, {_SKELETON} AS bones FROM v")
def x8_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)[0].select(F.col("word").alias("term"), T.skeleton("word").alias("bones"))


_RULES = _VOCAB.rstrip() + f""", b AS (SELECT term, {_SKELETON} AS bone FROM v), db AS (SELECT term, {_SKELETON} AS bone FROM d),
p AS (SELECT v.term AS key, d.term AS target FROM v JOIN d ON starts_with(v.term, d.term) AND length(v.term) > length(d.term)),
a AS (SELECT b.term AS key, db.term AS target FROM b JOIN db ON b.bone = db.bone AND length(b.term) > length(db.term)),
q AS (SELECT v.term AS key, d.term AS target FROM v JOIN d ON substring(v.term, 1, 1) = substring(d.term, 1, 1) AND length(d.term) <= 5 AND length(v.term) > length(d.term) AND length(v.term) <= 3 * length(d.term) AND regexp_matches(v.term, regexp_replace(d.term, '(.)', '\\1.*', 'g'))),
al AS (SELECT key, target, min(rule) AS rule FROM (SELECT *, 1 AS rule FROM p UNION ALL SELECT *, 2 FROM a UNION ALL SELECT *, 3 FROM q) GROUP BY key, target)
"""
_WHOLE_RULES = _RULES.replace(" WHERE i <= 40", "")
for _name, _rule, _rows, _held in (("x9_prefix", 1, _RULES, _vocabulary), ("x9_abbrev", 2, _WHOLE_RULES, _whole_vocabulary), ("x9_subseq", 3, _RULES, _vocabulary)):

    def _lexical(spark: SparkSession, sf_dir: str, reason: str = _name[3:], held: Callable = _held) -> DataFrame:
        return GR.lexical_pairs(*held(spark, sf_dir), [reason]).select("key", "target", "score")

    query(_name, _rows + f"SELECT key, target, {0.5 if _rule == 3 else 0.75}::DOUBLE AS score FROM al WHERE rule = {_rule}")(_lexical)


@query("w5_topk_per_key", _WHOLE_RULES + "SELECT key, target, ord FROM (SELECT key, target, row_number() OVER (PARTITION BY key ORDER BY CASE rule WHEN 3 THEN 0.5 ELSE 0.75 END DESC, target) AS ord FROM al) WHERE ord <= 4")
def w5_topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GR.top_targets(GR.lexical_pairs(*_whole_vocabulary(spark, sf_dir))).select("key", "target", "ord")


@query("s16_coverage", _WHOLE_RULES + "SELECT count(DISTINCT target) AS reached, (SELECT count(*) FROM v) AS words, round(count(DISTINCT target) * 1.0 / (SELECT count(*) FROM v), 6) AS share FROM al WHERE target IN (SELECT term FROM v)")
def s16_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, targets = _whole_vocabulary(spark, sf_dir)
    return GR.coverage(GR.lexical_pairs(words, targets), words.withColumnRenamed("word", "term"))


@query("x11_merge", """WITH l AS (SELECT o_custkey AS key, min(o_orderkey % 7) AS t, 0.5 AS s FROM orders GROUP BY o_custkey), v AS (SELECT o_custkey AS key, max(o_orderkey % 7) AS t, (o_custkey % 10) / 10.0 AS s FROM orders GROUP BY o_custkey),
m AS (SELECT coalesce(l.key, v.key) AS key, CAST(coalesce(l.t, v.t) AS VARCHAR) AS target, CAST(greatest(l.s, v.s) AS DOUBLE) AS score, CASE WHEN l.s IS NOT NULL THEN 'lexical' ELSE 'vector' END AS reason FROM l FULL JOIN v ON l.key = v.key AND l.t = v.t)
SELECT key, target, round(score, 6) AS score, reason FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, target) AS o FROM m) WHERE o <= 4""")
def x11_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key"))
    lexical = o.agg(F.min(F.col("o_orderkey") % 7).cast("string").alias("target")).withColumns({"score": F.lit(0.5), "reason": F.lit("lexical")})
    near = o.agg(F.max(F.col("o_orderkey") % 7).cast("string").alias("target")).withColumns({"score": (F.col("key") % 10) / 10.0, "reason": F.lit("vector")})
    return GR.merged(lexical, near).select("key", "target", F.round("score", 6).alias("score"), "reason")


@query("x12_meta_closure", """WITH d AS (SELECT DISTINCT CAST(o_orderkey % 60 AS VARCHAR) AS specific, CAST(o_custkey % 12 AS VARCHAR) AS general FROM orders WHERE o_orderkey % 60 <> o_custkey % 12),
w AS (SELECT general AS key, specific AS target, 1.0 AS score FROM d UNION ALL SELECT a.general, b.specific, 0.8 FROM d a JOIN d b ON a.specific = b.general UNION ALL SELECT a.general, c.specific, 0.64 FROM d a JOIN d b ON a.specific = b.general JOIN d c ON b.specific = c.general)
SELECT key, target, round(max(score), 6)::DOUBLE AS score, 'meta' AS reason FROM w WHERE key <> target GROUP BY key, target""")
def x12_meta_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 60 <> o_custkey % 12")
    return GR.meta_closure(o.select((F.col("o_orderkey") % 60).cast("string").alias("specific"), (F.col("o_custkey") % 12).cast("string").alias("general")))


_COSINE = """WITH c AS (SELECT q.vec_id AS id, t.vec_id AS target_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS cosine FROM embeddings q JOIN embeddings t ON q.vec_id % 2 = 0 AND t.vec_id % 2 = 1)
"""


@query("j15_cosine_topk", _COSINE + "SELECT id, target_id, round(cosine, 6) AS cosine, ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, target_id) AS ord FROM c) WHERE ord <= 5")
def j15_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GR.cosine_top(*A.vectors(spark, sf_dir), 5).select("id", "target_id", F.round("cosine", 6).alias("cosine"), "ord")


_SHIFT = 0.09


@query("x10_vector_score", f"""WITH v AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x + {_SHIFT}) AS v FROM embeddings), c AS (SELECT q.id, t.id AS target_id, list_cosine_similarity(q.v, t.v) AS cosine FROM v q, v t)
SELECT id, target_id, score FROM (SELECT id, target_id, round(0.6 * greatest(least((cosine - 0.55) / 0.45, 1), 0), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, target_id) AS ord FROM c) WHERE ord <= 5) WHERE score >= 0.05""")
def x10_vector_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against all, moved alike so that near ones pass the floor."""
    moved = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") + _SHIFT).alias("v"))
    found = GR.cosine_top(moved, moved, 5)
    return found.select("id", "target_id", GR.vector_score(F.col("cosine")).alias("score")).where("score IS NOT NULL")


@query("s28_semantic_neighbours", """WITH t AS (SELECT vec_id AS id, 't' || CAST(vec_id AS VARCHAR) AS term, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT * FROM t WHERE id % 50 = 0),
c AS (SELECT q.id, t.term, list_cosine_similarity(q.v, t.v) AS cosine FROM q JOIN t ON t.id <> q.id AND t.id <> q.id + 1)
SELECT id, term, round(greatest(cosine, 0), 6) AS score, ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, term) AS ord FROM c) WHERE ord <= 10""")
def s28_semantic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id 50 divides ask all; a query's own words are itself and the vector after it."""
    e = table(spark, sf_dir, "embeddings")
    word = lambda i: F.concat(F.lit("t"), i.cast("string"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    own = asked.select("id", F.explode(F.array(word(F.col("id")), word(F.col("id") + 1))).alias("term"))
    return M.semantic_neighbours(asked, e.select(word(F.col("vec_id")).alias("term"), F.col("embedding").alias("v")), own)


@query("s27_phrase_similarity", """WITH p AS (SELECT p_partkey AS id, unnest([p_partkey % 90, (p_partkey * 7) % 70, 100000 + p_partkey]) AS w FROM part),
m AS (SELECT id, i, avg(x) AS x FROM (SELECT id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM p JOIN embeddings ON vec_id = w) GROUP BY id, i),
l AS (SELECT id, list(x ORDER BY i) AS v FROM m GROUP BY id)
SELECT a.id AS a, b.id AS b, round(greatest(list_cosine_similarity(a.v, b.v), 0), 6) AS similarity FROM l a JOIN l b ON b.id = a.id + 1""")
def s27_phrase_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as phrases of three words, of which one has no vector; each against the next."""
    i = F.col("p_partkey").cast("long")
    phrases = table(spark, sf_dir, "part").select(i.alias("id"), F.transform(F.array(i % 90, (i * 7) % 70, i + 100_000), lambda x: x.cast("string")).alias("words"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").alias("v"))
    following = phrases.select(F.col("id").alias("a")).join(phrases.select((F.col("id") - 1).alias("a"), F.col("id").alias("b")), "a")
    return M.phrase_similarity(following, phrases, vectors).withColumn("similarity", F.round("similarity", 6))


@query("s17_recall", _TOTAL + """, r AS (SELECT symbol_id, row_number() OVER (ORDER BY round(score, 9) DESC, symbol_id) AS rank FROM total), g AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT k, round(count(rank) * 1.0 / (SELECT count(*) FROM g), 6) AS recall FROM (VALUES (10), (30), (100)) t(k) LEFT JOIN (SELECT rank FROM r JOIN g ON g.doc_id = r.symbol_id) x ON rank <= k GROUP BY k""")
def s17_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = working_set(documents(spark, sf_dir)).score()
    gold = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("name"))
    return M.recall_at(scores.select(F.col("symbol_id").alias("name"), "symbol_id", "score"), gold, [10, 30, 100]).select("k", F.round("recall", 6).alias("recall"))


@query("p14_episodes", r"""WITH s AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_-]{2,}'), lambda x: lower(x))) AS tokens FROM conversations WHERE role = 'user'),
l AS (SELECT *, lag(turn) OVER w AS pt, lag(tokens) OVER w AS ptok FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT conv_id, turn, CASE WHEN pt IS NOT NULL AND turn - pt <= 2 AND len(list_intersect(tokens, ptok)) >= 0.1 * least(len(tokens), len(ptok)) AND least(len(tokens), len(ptok)) > 0 THEN 0 ELSE 1 END AS fresh FROM l)
SELECT conv_id, turn, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS episode FROM f""")
def p14_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return TR.episodes(c.select("conv_id", "turn", F.lit("search").alias("tool"), TR.episode_tokens(F.col("text")).alias("tokens")), overlap=0.1).select("conv_id", "turn", "episode")


@query("p15_prompt_prefix", "SELECT conv_id, turn, count(*) OVER w AS before, coalesce(sum(length(text)) OVER w, 0) AS chars FROM conversations WHERE role <> 'tool' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def p15_prompt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.prefixes(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "before", "chars")


@query("x25_query_validity", r"SELECT conv_id, turn, trim(text) <> '' AND NOT regexp_matches(text, '[\n`]') AND NOT regexp_matches(text, '(^|\s)/[A-Za-z]') AND NOT regexp_matches(text, '\b(rg|grep)\b') AS valid FROM conversations")
def x25_query_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", TR.valid_query(F.col("text")).alias("valid"))


@query("f13_type_filter", "SELECT p_partkey AS symbol_id FROM part WHERE lower(p_type) IN ('promo', 'small')")
def f13_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.of_types(A.symbols_parts(spark, sf_dir), ["Promo", "SMALL"]).select("symbol_id")


@query("f14_path_predicate", r"SELECT page_id FROM pages WHERE ends_with(url, '.html') OR contains('/' || url || '/', '/fr/')")
def f14_path_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.where(X.path_matches(F.col("url"), ".html", suffix=True) | X.path_matches(F.col("url"), "fr")).select("page_id")


@query("f16_regex_and", r"SELECT p_partkey AS symbol_id FROM part WHERE regexp_matches(lower(p_name), 'small') AND regexp_matches(p_name, '\bring\b')")
def f16_regex_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.keyword_search(A.symbols_parts(spark, sf_dir), [("SMALL", False, False), ("ring", True, True)], every=True).select("symbol_id")


@query("f17_exact", "SELECT p_partkey AS symbol_id, CASE WHEN replace(lower(p_name), '_', '') = 'small ring' THEN 1.0 ELSE 0.8 END::DOUBLE AS score FROM part WHERE contains(replace(lower(p_name), '_', ''), 'small ring') OR replace(lower(p_name), '_', '') = 'small ring' ORDER BY score DESC, symbol_id LIMIT 50")
def f17_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.exact_search(A.symbols_parts(spark, sf_dir), "Small_ ring".replace("_ ", " "), 50)


@query("f18_meaningful", r"SELECT DISTINCT w AS word FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS w FROM benchmark) WHERE w = 'a' OR (length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ('the', 'and', 'of'))")
def f18_meaningful(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return words.where(X.meaningful(F.col("word"), stop=["the", "and", "of"], keep=["a"]))


_LADDER = "CASE WHEN ex >= 0.6 THEN 'discard' WHEN inc >= 0.55 AND ex < 0.35 THEN 'keep' WHEN inc < 0.2 THEN 'discard' ELSE 'gray' END"


@query("p12_decision_ladder", f"SELECT l_orderkey, l_linenumber, l_partkey, {_LADDER} AS decision FROM (SELECT *, l_quantity / 50 AS inc, l_discount * 8 AS ex FROM lineitem)")
def p12_decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"inc": F.col("l_quantity") / 50, "ex": F.col("l_discount") * 8})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", X.decision(F.col("inc"), F.col("ex")).alias("decision"))


@query("s20_chain_icf", DOCS + "SELECT term, round(ln(n / df), 6) AS icf, row_number() OVER (ORDER BY ln(n / df), term) <= greatest(ceil(0.1 * count(*) OVER ()), 1) AS frequent FROM terms, n")
def s20_chain_icf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = documents(spark, sf_dir)
    return M.chain_icf(ctx.terms.select("term", "df"), ctx.total).select("term", F.round("icf", 6).alias("icf"), "frequent")


@query("s19_symbol_degrees", """WITH e AS (SELECT 100000000 + l_orderkey AS src, 10000000000 + l_partkey AS dst, CASE WHEN l_suppkey % 2 = 0 THEN 10000 + l_suppkey END AS impl FROM lineitem),
i AS (SELECT id, count(DISTINCT src) AS n_in FROM (SELECT dst AS id, src FROM e UNION ALL SELECT impl, src FROM e WHERE impl IS NOT NULL) GROUP BY id), o AS (SELECT src AS id, count(DISTINCT coalesce(impl, dst)) AS n_out FROM e GROUP BY src)
SELECT coalesce(i.id, o.id) AS symbol_id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM i FULL JOIN o ON i.id = o.id""")
def s19_symbol_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call parts, for which every other supplier stands."""
    off, null = A.OFFSETS, F.lit(None).cast("long")
    impl = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey") + off["supplier"])
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + off["order"]).alias("src"), null.alias("src_impl"), (F.col("l_partkey") + off["part"]).alias("dst"), impl.alias("dst_impl"))
    return G.symbol_degrees(edges)


@query("s21_penalised", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax <= 0.04 AND l_discount <= 0.04 THEN l_quantity / 50 * least((l_tax + l_discount) / 2 / 0.04, 1) ELSE l_quantity / 50 END, 6) AS sim FROM lineitem")
def s21_penalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = X.penalised(F.col("l_quantity") / 50, F.col("l_tax"), F.col("l_discount"), 0.04)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(sim, 6).alias("sim"))


@query("s22_hybrid", "SELECT l_orderkey, l_linenumber, l_partkey, round(0.4 * greatest(l_tax * 10 - 0.2, 0) + 0.6 * greatest(l_discount * 10 - 0.3, 0), 6) AS score FROM lineitem")
def s22_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(X.hybrid(F.col("l_tax") * 10 - 0.2, F.col("l_discount") * 10 - 0.3), 6).alias("score"))


@query("s24_include_exclude", "WITH b AS (SELECT l_orderkey AS c, l_suppkey % 4 AS q, max(l_quantity / 50) AS s FROM lineitem GROUP BY 1, 2) SELECT c AS candidate, round(avg(s), 6) AS include, round(max(s), 6) AS exclude FROM b GROUP BY c")
def s24_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate"), (F.col("l_suppkey") % 4).alias("term"), (F.col("l_quantity") / 50).alias("score"))
    return X.include_exclude(rows).select("candidate", F.round("include", 6).alias("include"), F.round("exclude", 6).alias("exclude"))


@query("s25_quantile", "SELECT o_orderpriority AS k, round(quantile_cont(o_totalprice, 0.4), 4) AS q40, round(quantile_cont(o_totalprice, 0.8), 4) AS q80 FROM orders GROUP BY o_orderpriority")
def s25_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.quantiles(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", [0.4, 0.8])
    return found.select(F.col("o_orderpriority").alias("k"), F.round("q40", 4).alias("q40"), F.round("q80", 4).alias("q80"))


@query("w7_tiers", "SELECT symbol_id, CASE WHEN r <= greatest(ceil(0.1 * n), 1) THEN 1 WHEN r <= greatest(ceil(0.1 * n), 1) + ceil(0.2 * n) THEN 2 ELSE 3 END AS tier FROM (SELECT p_partkey AS symbol_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER () AS n FROM part)")
def w7_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.tiers(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_retailprice").alias("score"))).select("symbol_id", "tier")


@query("w9_adaptive_k", "SELECT p_partkey AS id, CASE WHEN p_size IS NULL THEN 10 WHEN p_size / 50.0 >= 0.5 THEN 3 WHEN p_size / 50.0 >= 0.25 THEN 5 WHEN p_size / 50.0 >= 0.1 THEN 8 ELSE 10 END AS k FROM part")
def w9_adaptive_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.adaptive_k(F.col("p_size") / 50.0).alias("k"))


@query("x23_chain_corpus", """WITH c AS (SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey) AS c FROM orders GROUP BY o_custkey),
s AS (SELECT k, array_to_string(c, ' ') AS line, 1 AS n FROM c UNION ALL SELECT k, array_to_string(c[i:i + 1], ' '), 5 FROM (SELECT k, c, unnest(range(1, len(c))) AS i FROM c) UNION ALL SELECT k, array_to_string(c[i:i + 2], ' '), 2 FROM (SELECT k, c, unnest(range(1, len(c) - 1)) AS i FROM c))
SELECT k, line, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY k, line""")
def x23_chain_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("c"))
    return chains.select("k", F.explode(T.window_corpus(F.col("c"))).alias("s")).groupBy("k", F.array_join("s", " ").alias("line")).agg(F.count("*").alias("n"))


@query("x27_condition_terms", """SELECT event_id, [event_type, CAST(user_id AS VARCHAR), 'top', 'more'] AS terms FROM events""")
def x27_condition_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as structured queries: included words of three kinds of conditions and of the top level; excluded ones stay out."""
    item = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    word, user = F.col("event_type"), F.col("user_id").cast("string")
    conditions = F.struct(
        F.struct(F.array(item(keywords=F.array(word, F.lit("")), term=word)).alias("include"), F.array(item(keywords=F.array(F.lit("gone")))).alias("exclude")).alias("surface"),
        F.struct(F.array(item(synonyms=F.array(user, word), other=F.lit("unread"))).alias("include")).alias("intention"),
        F.struct(F.array(item(term=F.lit("top"))).alias("include")).alias("relation"),
    )
    payload = F.to_json(F.struct(conditions.alias("conditions"), F.array(F.lit("top"), F.lit("more")).alias("keywords")))
    return table(spark, sf_dir, "events").select("event_id", T.condition_terms(payload).alias("terms"))


@query("x28_abbr_check", r"SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') = regexp_replace(p_name || p_size % 5, '[^0-9]', '', 'g') AND (regexp_replace(p_brand, '[^A-Za-z]', '', 'g') = '') = (regexp_replace(p_name || p_size % 5, '[^A-Za-z]', '', 'g') = '') AS agrees FROM part")
def x28_abbr_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.abbreviation_agrees(F.col("p_brand"), F.concat("p_name", (F.col("p_size") % 5).cast("string"))).alias("agrees"))


@query("s27_average_vector", "WITH d AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) SELECT label, round(sum(m * m), 5) AS norm2, count(*) AS dims FROM d GROUP BY label")
def s27_average_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = M.mean_vectors(table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), F.col("embedding").alias("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return mean.select(F.col("key").alias("label"), F.round(norm, 5).alias("norm2"), F.size("v").cast("long").alias("dims"))


@query("s29_mismatch", DOCS.rstrip() + """, v AS (SELECT term, icf, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT term, icf, row_number() OVER (ORDER BY df DESC, term) - 1 AS r FROM terms) JOIN embeddings ON vec_id = r),
p AS (SELECT DISTINCT symbol_id, term FROM post WHERE field = 'name'), c AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM p a JOIN p b ON a.symbol_id = b.symbol_id AND a.term <> b.term GROUP BY a.term, b.term)
SELECT c.a AS term, count(*) AS partners, round(sum(n * y.icf * list_cosine_similarity(x.v, y.v)) / sum(n * y.icf), 6) AS agreement FROM c JOIN v x ON x.term = c.a JOIN v y ON y.term = c.b GROUP BY c.a HAVING count(*) >= 3 AND sum(n * y.icf) > 0""")
def s29_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest terms bear the table's vectors, in order."""
    ctx, e = documents(spark, sf_dir), table(spark, sf_dir, "embeddings")
    common = I.vocabulary(ctx.terms, e.count()).withColumn("vec_id", F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1)
    vectors = common.join(e, "vec_id").select("term", F.col("embedding").alias("v"))
    return M.mismatch(ctx.postings.where("field = 'name'").select("symbol_id", "term").distinct(), ctx.terms, vectors).select("term", "partners", F.round("agreement", 6).alias("agreement"))


@query("u7_condition_expression", "SELECT p_partkey AS symbol_id FROM part WHERE (p_type = 'PROMO' AND p_size > 20 OR p_brand = 'Brand#1') AND NOT (p_size % 5 = 0)")
def u7_condition_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.symbols_parts(spark, sf_dir)
    return X.condition_expression([("type", ("kind",), p.where("kind = 'PROMO'")), ("type", ("kind",), p.where("size > 20")), ("file", ("file",), p.where("file = 'Brand#1'"))], [p.where("size % 5 = 0")]).select("symbol_id")


@query("u10_relation_plan", "SELECT p_partkey AS symbol_id FROM part WHERE p_size > 10 AND p_type IN ('PROMO', 'LARGE') AND NOT (p_brand IN ('Brand#3', 'Brand#4'))")
def u10_relation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.symbols_parts(spark, sf_dir)
    return X.relation_plan(p, [p.where("size > 10"), p.where("kind IN ('PROMO', 'LARGE')")], [p.where("file = 'Brand#3'"), p.where("file = 'Brand#4'"), None]).select("symbol_id")


@query("j10_equivalents", """WITH RECURSIVE p AS (SELECT DISTINCT least(s_nationkey, s_suppkey % 25) AS a, greatest(s_nationkey, s_suppkey % 25) AS b FROM supplier WHERE s_nationkey <> s_suppkey % 25), u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(id, pos) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.pos) SELECT CAST(id AS BIGINT) AS id, CAST(min(pos) AS BIGINT) AS comp FROM r GROUP BY id""")
def j10_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return G.equivalents(s.select(F.col("s_nationkey").cast("long").alias("abstract"), (F.col("s_suppkey") % 25).alias("impl")))


_CODE = """WITH s AS (SELECT p_partkey AS symbol_id, replace(p_name, ' ', '_') AS name, CASE p_size % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'class' ELSE 'field' END AS kind, p_type AS signature, replace(p_brand, '#', '/') || '/' || p_type AS file FROM part)
"""
ITEMS = [("Small Widget".replace(" ", ""), "method", True), ("cold_Widget", "class", True), ("economy", "unknown", True), ("13/PROMO", "file", False), ("3/PROMO", "file", True), ("large_bolt", "enum", True)]


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods, classes and fields, in files of a folder for each brand."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "method").when(F.col("p_size") % 3 == 1, "class").otherwise("field")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), kind.alias("kind"), F.col("p_type").alias("signature"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit("/"), F.col("p_type")).alias("file"))


@query("f17_exact_elements", _CODE + """SELECT symbol_id, 'SmallWidget' AS query, 'name' AS field, 2.0::DOUBLE AS score FROM s WHERE kind = 'method' AND lower(name) = 'small_widget'
UNION ALL SELECT symbol_id, 'cold_Widget', 'name', 2.0 FROM s WHERE kind = 'class' AND lower(name) = 'cold_widget'
UNION ALL SELECT symbol_id, 'economy', 'signature', 1.65 FROM s WHERE signature = 'ECONOMY'
UNION ALL SELECT symbol_id, '13/PROMO', 'file', 1.45 FROM s WHERE file LIKE '%/13/PROMO'
UNION ALL SELECT symbol_id, '3/PROMO', 'file', 1.75 FROM s WHERE file LIKE '%/3/PROMO'""")
def f17_exact_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.exact_elements(_code(spark, sf_dir), ITEMS, top=None)


@query("f14_in_path", "SELECT 'src1' AS wanted, doc_id AS symbol_id FROM documents WHERE source = 'src1' UNION ALL SELECT source || '/' || doc_id, doc_id FROM documents WHERE source || '/' || doc_id IN ('src0/0', 'src1/1')")
def f14_in_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = A.symbols_documents(spark, sf_dir)
    out = [X.filtered(symbols, "path", wanted=w).select(F.lit(w).alias("wanted"), "symbol_id") for w in ("src1", "src0/0", "src1/1")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("f15_with_roles", _EDGES + """SELECT id AS symbol_id FROM node LEFT JOIN (SELECT src, count(*) AS o FROM e WHERE kind = 'calls' GROUP BY src) ON src = id LEFT JOIN (SELECT dst, count(*) AS i FROM e WHERE kind = 'calls' GROUP BY dst) ON dst = id
WHERE kind NOT IN ('customer', 'order', 'part') OR (coalesce(i, 0) = 0 AND coalesce(o, 0) > 0) OR (coalesce(i, 0) = 0 AND coalesce(o, 0) = 0)""")
def f15_with_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, _ = _star(spark, sf_dir)
    return G.with_roles(ctx.symbols, ctx.edge_table.where("kind = 'calls'"), ["entry_point", "isolate"], ("customer", "order", "part")).select("symbol_id")


@query("u8_clauses", """SELECT p_partkey AS symbol_id, 'subtract' AS does FROM part WHERE p_name LIKE '%widget%' AND p_name LIKE '%small%' AND NOT (p_type = 'PROMO' OR p_size > 40)
UNION ALL SELECT p_partkey, 'identity' FROM part WHERE p_name LIKE '%bolt%' UNION ALL SELECT p_partkey, 'exclude_only' FROM part WHERE p_type = 'LARGE' OR p_type = 'SMALL'""")
def u8_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.symbols_parts(spark, sf_dir)
    named = lambda w: X.keyword_search(p, [(w, False, False)])
    ran = [
        X.condition(X.clause([named("widget"), named("small")]), X.clause([p.where("kind = 'PROMO'"), p.where("size > 40")], include=False)),
        X.condition(X.clause([named("bolt")]), X.clause([])),
        X.condition(X.clause([]), X.clause([p.where("kind = 'LARGE'"), p.where("kind = 'SMALL'")], include=False)),
    ]
    rows = [found.select("symbol_id", F.lit(does).alias("does")) for does, found in ran]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("p10_surface_relation", """SELECT p_partkey AS symbol_id FROM part WHERE ((p_type = 'PROMO' AND p_name LIKE '%widget%' AND p_name NOT LIKE '%cold%') OR regexp_matches(p_name, '\\bbolt\\b')) AND p_name NOT LIKE '%large%'
AND (p_name LIKE '%small%' OR p_name LIKE '%b%') AND NOT (p_type = 'ECONOMY' AND p_name LIKE '%small%')""")
def p10_surface_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.symbols_parts(spark, sf_dir)
    asked = [{"types": ["promo"], "include": [["widget"]], "exclude": [["cold"]]}, {"include": [[{"text": "bolt", "whole": True}], []]}, {"types": ["any"], "exclude": [["large"]]}]
    found = PS.surface(p, [PS.SurfaceCondition.of(x) for x in asked])
    plan = PS.RelationPlan(include=((("keyword", {"keywords": [("small", False, False), ("b", False, False)]}),), ()), exclude=((("types", {"types": ["economy"]}), ("keyword", {"keywords": [("small", False, False)]})),))
    return plan.run(p.join(found, "symbol_id", "left_semi")).select("symbol_id")


_CLUSTERS = """WITH c AS (SELECT p_partkey AS symbol_id, p_brand AS cluster, CAST(substring(p_brand, 7) AS INTEGER) / 30.0 AS cs, p_retailprice AS score, p_size / 50.0 AS include, (p_partkey % 10) / 10.0 AS exclude FROM part),
k AS (SELECT cluster, row_number() OVER (ORDER BY cs DESC, cluster) AS place, count(*) OVER () AS n FROM (SELECT cluster, max(cs) AS cs FROM c GROUP BY cluster)),
b AS (SELECT *, ceil(n * 0.6) AS kept, least(ceil(n * 0.6), greatest(ceil(n * 0.1), 1)) AS one FROM k),
t AS (SELECT cluster, CASE WHEN place <= one THEN 1 WHEN place <= one + least(kept - one, ceil(n * 0.2)) THEN 2 WHEN place <= kept THEN 3 ELSE 4 END AS tier FROM b)
"""


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("cluster"), (F.substr("p_brand", F.lit(7)).cast("int") / 30.0).alias("cluster_score"), F.col("p_retailprice").alias("score"), (F.col("p_size") / 50.0).alias("include"), ((F.col("p_partkey") % 10) / 10.0).alias("exclude"))


@query("w8_cluster_tiers", _CLUSTERS + "SELECT symbol_id, cluster, tier, CASE WHEN tier < 4 THEN 'kept' ELSE 'rescue' END AS outcome, row_number() OVER (PARTITION BY tier ORDER BY cs DESC, score DESC, symbol_id) AS tier_rank FROM c JOIN t USING (cluster)")
def w8_cluster_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cluster_tiers(_clustered(spark, sf_dir), defer=True)


@query("p11_intention", _CLUSTERS.rstrip() + """,
l AS (SELECT symbol_id, include, CASE WHEN exclude >= 0.6 THEN 'discard' WHEN include >= 0.55 AND exclude < 0.35 THEN 'keep' WHEN include < 0.2 THEN 'discard' ELSE 'gray' END AS d FROM c JOIN t USING (cluster) WHERE tier < 4),
q AS (SELECT quantile_cont(include, 0.4) AS low, quantile_cont(include, 0.8) AS high FROM l WHERE d = 'gray'),
a AS (SELECT symbol_id, CASE WHEN d <> 'gray' OR q.low IS NULL OR high - low < 1e-9 THEN d WHEN include >= high THEN 'keep' WHEN include < low THEN 'discard' ELSE 'gray' END AS d FROM l, q)
SELECT symbol_id, 'cluster' AS stage, 'discard' AS decision FROM c JOIN t USING (cluster) WHERE tier = 4 UNION ALL SELECT symbol_id, CASE WHEN d = 'gray' THEN 'left' ELSE 'embedding' END, CASE WHEN d = 'gray' THEN 'keep' ELSE d END FROM a""")
def p11_intention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PS.intention(_clustered(spark, sf_dir), PS.IntentionPlan(defer=False))


@query("x14_corpus_sentences", "SELECT p_partkey AS symbol_id, list_concat(w, CASE WHEN list_contains(w, lower(p_type)) THEN ['brand'] ELSE [lower(p_type), 'brand'] END) AS words FROM (SELECT *, string_split(lower(p_name), ' ') AS w FROM part)")
def x14_corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    notes = F.array(F.struct(F.col("p_brand").alias("name"), F.lit("").alias("args")))
    return I.corpus_sentences(p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("doc"), notes.alias("annotations")))


_COMPOUNDS = "WITH c AS (SELECT p_partkey AS symbol_id, lower(p_name) AS name, replace(lower(p_name), ' ', '') AS term FROM part)\n"


def _compounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names of parts written as one word, as postings, and their words with counts."""
    p = table(spark, sf_dir, "part")
    posted = p.select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")).alias("term"), F.col("p_partkey").cast("long").alias("symbol_id"), F.lit("name").alias("field"), F.lit(1).cast("long").alias("tf"))
    words = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return posted, words


@query("x3_viterbi", _COMPOUNDS + "SELECT DISTINCT term, string_split(name, ' ') AS pieces FROM c WHERE length(term) >= 6")
def x3_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted, words = _compounds(spark, sf_dir)
    return T.segmented(posted.select("term").distinct(), words)


@query("x4_refine", _COMPOUNDS + "SELECT term, symbol_id, 'name' AS field, CAST(count(*) AS BIGINT) AS tf FROM (SELECT term, symbol_id FROM c UNION ALL SELECT unnest(string_split(name, ' ')), symbol_id FROM c WHERE length(term) >= 6) GROUP BY term, symbol_id")
def x4_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted, words = _compounds(spark, sf_dir)
    return I.refined(posted, T.segmented(posted.select("term").distinct(), words))


@query("x26_code_tokens", _COMPOUNDS + "SELECT DISTINCT term AS text, CASE WHEN term LIKE 'cold%' THEN [term] ELSE string_split(name, ' ') END AS tokens FROM c WHERE length(term) >= 6 UNION SELECT DISTINCT upper(left(p_name, 1)) || substring(replace(p_name, ' ', 'X'), 2), [lower(split_part(p_name, ' ', 1)), 'x' || lower(split_part(p_name, ' ', 2))] FROM part")
def x26_code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as one word and with a capital in between; those that begin with cold are taken for words of their own."""
    posted, words = _compounds(spark, sf_dir)
    joined = F.replace("p_name", F.lit(" "), F.lit("X"))
    cased = table(spark, sf_dir, "part").select(F.concat(F.upper(F.left(joined, F.lit(1))), F.substr(joined, F.lit(2))).alias("text"))
    return I.code_tokens(posted.select(F.col("term").alias("text")).unionByName(cased), words, posted.where("term LIKE 'cold%'").select("term"))


@query("x18_fuzzy")
def x18_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", T.fuzzy_match(F.col("p_name"), F.lit("Small Ring")).alias("score")).where("score > 0")


@query("q6_intent_null", _TOTAL + "SELECT symbol_id, 'fallback' AS source, 'unsure' AS label, 'not judged' AS reason, 0.0::DOUBLE AS score FROM (SELECT symbol_id FROM total ORDER BY round(total.score, 9) DESC, symbol_id LIMIT 60)")
def q6_intent_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.operators.intent import intent

    ctx = documents(spark, sf_dir)
    return intent(S.top(working_set(ctx), 60), "weather", ctx).verdicts


@query("p8_script", UNITS_SQL.rstrip() + f""",
own AS (SELECT *, CASE WHEN detail = 'oner' OR detail LIKE '%←oner(%' THEN 'r' ELSE 'q' END AS u FROM hits WHERE unit = 'query' AND (detail IN ('thor', 'heit', 'oner') OR detail LIKE '%←oner(%' OR detail LIKE '%←heit(%')),
per AS (SELECT symbol_id, u, {_OR} AS score FROM own GROUP BY symbol_id, u),
x AS (SELECT symbol_id, sum(score) AS score FROM per WHERE symbol_id NOT IN (SELECT symbol_id FROM per JOIN documents ON doc_id = symbol_id WHERE u = 'r' AND source = 'src3') GROUP BY symbol_id)
""" + _RANK.format("x", "x", 15))
def p8_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragmill.plans.script import run_script

    text = "a = eval_unit(unit('q', lexical(['thor', 'heit'])))\nb = eval_unit(unit('r', lexical(['oner'])))\nanswer = top((a | b) - only(b, kind='src3'), 15)\n"
    return S.ranked(run_script(text, documents(spark, sf_dir)), 15).select("rank", "symbol_id", "kind", "score")
