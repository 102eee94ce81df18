"""The star-schema, event and document tables as corpora of symbols, postings and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.functions import text as T
from fragmill.model import Context
from fragmill.operators import index as I
from fragmill.session import table

# Fixed value: characters of a doc that a symbol row shows; its postings see more.
DOC_SHOWN = 400

# Offsets that keep the keys of the tables apart in one id space.
OFFSETS = {"region": 0, "nation": 1_000, "supplier": 10_000, "customer": 1_000_000, "order": 100_000_000, "part": 10_000_000_000}


def symbols_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as symbols: their first five words name them, their source is kind and container."""
    d = table(spark, sf_dir, "documents")
    name = F.array_join(T.words_of("text", 5), " ")
    return d.select(F.col("doc_id").alias("symbol_id"), name.alias("name"), F.col("source").alias("kind"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file"), F.col("source").alias("container"), F.col("lang").alias("language"), F.col("text").alias("doc"))


def symbols_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("long").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file"), F.col("p_brand").alias("container"), F.col("p_size").alias("size"))


def postings_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the first words of each text, as the SQL of their queries fixes."""
    return I.postings(I.declaration_terms(symbols_documents(spark, sf_dir), doc_words=T.DOC_WORDS))


def frequencies_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term and df over whole texts."""
    return I.symbol_frequencies(symbols_documents(spark, sf_dir))


def postings_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and events as annotated symbols (events lie above orders by an offset)."""
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    note = lambda name, args: F.array(F.struct(name.alias("name"), args.alias("args")))
    orders = o.select(F.col("o_orderkey").alias("symbol_id"), note(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("annotations"), F.array(F.lit("Static")).alias("modifiers"))
    events = e.select((F.col("event_id") + OFFSETS["part"]).alias("symbol_id"), note(F.col("event_type"), F.col("props")).alias("annotations"), F.array(F.lit("Final")).alias("modifiers"))
    return I.postings(I.declaration_terms(orders.unionByName(events)))


def _edge(src: Column, dst: Column, kind: str, confidence: Column, provenance: Column) -> list[Column]:
    return [src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence"), provenance.alias("provenance")]


def edges_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions contain nations contain suppliers and customers; customers call orders call parts, once for each line."""
    off = {k: F.lit(v) for k, v in OFFSETS.items()}
    derived, one = F.lit("derived_container"), F.lit(1.0)
    t = lambda name: table(spark, sf_dir, name)
    nations = t("nation").select(*_edge(F.col("n_regionkey"), off["nation"] + F.col("n_nationkey"), "contains", one, derived))
    suppliers = t("supplier").select(*_edge(off["nation"] + F.col("s_nationkey"), off["supplier"] + F.col("s_suppkey"), "contains", one, derived))
    customers = t("customer").select(*_edge(off["nation"] + F.col("c_nationkey"), off["customer"] + F.col("c_custkey"), "contains", one, derived))
    orders = t("orders").select(*_edge(off["customer"] + F.col("o_custkey"), off["order"] + F.col("o_orderkey"), "calls", one, F.lit("typed_receiver")))
    how = F.when(F.col("l_returnflag") == "N", "typed_receiver").otherwise("name_match")
    lines = t("lineitem").select(*_edge(off["order"] + F.col("l_orderkey"), off["part"] + F.col("l_partkey"), "calls", 1 - F.col("l_discount"), how))
    return nations.unionByName(suppliers).unionByName(customers).unionByName(orders).unionByName(lines)


def symbols_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of ``edges_star``."""
    rows = None
    for name, key, label in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("orders", "o_orderkey", "o_orderstatus"), ("part", "p_partkey", "p_name")):
        kind = name.removesuffix("s") if name == "orders" else name
        part = table(spark, sf_dir, name).select((F.col(key).cast("long") + OFFSETS[kind]).alias("symbol_id"), F.col(label).cast("string").alias("name"), F.lit(kind).alias("kind"), F.lit(name).alias("file"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def documents_context(spark: SparkSession, sf_dir: str, expansion: DataFrame | None = None) -> Context:
    symbols = symbols_documents(spark, sf_dir).withColumn("doc", F.substring("doc", 1, DOC_SHOWN))
    return Context(symbols, postings_documents(spark, sf_dir), expansion=expansion)


def star_context(spark: SparkSession, sf_dir: str) -> Context:
    symbols = symbols_star(spark, sf_dir)
    return Context(symbols, I.postings(I.declaration_terms(symbols)), edges=edges_star(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys (even ids) and targets (odd ids)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")
