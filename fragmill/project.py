"""A corpus from sources to a searchable index: build, open, search, describe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragmill.functions import text as T
from fragmill.model import Context
from fragmill.operators import graph as G
from fragmill.operators import grounding as GR
from fragmill.operators import index as I
from fragmill.search import SearchResult, search
from fragmill.session import cut
from fragmill.sources import files as S
from fragmill.sources import java_facts, store

INDEXED = ("class", "interface", "enum", "record", "annotation_type", "method", "constructor", "field", "function")


def numbered(declarations: DataFrame) -> DataFrame:
    """Declarations with dense symbol ids from 1, in order of file and line.

    Each file counts its own rows; only the counts of files meet in one order.
    """
    per = declarations.groupBy("file").agg(F.count("*").alias("n"))
    before = per.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    own = Window.partitionBy("file").orderBy("span.start", "name", "kind")
    return declarations.join(before, "file").withColumn("symbol_id", (F.col("before") + F.row_number().over(own)).cast("long")).drop("before")


def call_tables(symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls with the types of their receivers, members by owner, and supertypes.

    self and this are the own type; a name is a variable of the method's scope,
    else a field of the owner, else a type if it is capitalised; others stay untyped.
    """
    owner = F.element_at(F.split("container", r"\."), -1)
    scope = F.col("locals") if "locals" in symbols.columns else F.lit(None).cast("map<string,string>")
    bare = F.regexp_replace("c.receiver", r"^(this|self)\.", "")
    calls = symbols.select(F.col("symbol_id").alias("src"), owner.alias("own"), scope.alias("scope"), F.explode("calls").alias("c")).select("src", "own", F.col("c.name").alias("name"), bare.alias("receiver"), F.try_element_at("scope", bare).alias("local")).distinct()
    # A field's signature leads with its type: the last name of it, before any parameters.
    kind = F.regexp_extract("signature", r"^(?:[\w$]+\.)*([A-Z][\w$]*)", 1)
    fields = symbols.where("kind = 'field'").groupBy(owner.alias("own"), F.col("name").alias("receiver")).agg(F.min(F.nullif(kind, F.lit(""))).alias("field"))
    kinds = F.when(F.col("receiver").isin("self", "this", "cls"), F.col("own")).otherwise(F.coalesce("local", "field", F.when(F.col("receiver").rlike("^[A-Z]"), F.col("receiver"))))
    members = symbols.where(F.col("kind").isin("method", "constructor", "function")).select("symbol_id", owner.alias("owner"), "name")
    up = symbols.select(F.col("name").alias("type"), F.explode("supertypes").alias("parent"))
    return calls.join(fields, ["own", "receiver"], "left").select("src", "name", kinds.alias("receiver_type")).distinct(), members, up


def resolved_calls(symbols: DataFrame) -> DataFrame:
    """Call edges of the declarations' calls; receivers without a type go by name."""
    return G.call_edges(*call_tables(symbols))


def build(spark: SparkSession, path: str, sources: Sequence[tuple[str, str]] | DataFrame, *, name: str = "corpus", direct_annotations: DataFrame | None = None) -> dict:
    """Builds an index at ``path`` from (root, language) pairs or a table of declarations; returns its metadata.

    Scan, number, post, segment over the whole lexicon, link, ground, save.
    """
    if isinstance(sources, DataFrame):
        scanned, languages = sources, []
    else:
        scanned, languages = None, sorted({lang for _, lang in sources})
        for root, lang in sources:
            rows = S.declarations(S.source_files(spark, root, lang), lang).withColumn("language", F.lit(lang))
            scanned = rows if scanned is None else scanned.unionByName(rows)
    scanned = cut(scanned)
    failed = scanned.where("error IS NOT NULL").select("file").distinct().count() if "error" in scanned.columns else 0
    whole = scanned.where("error IS NULL") if "error" in scanned.columns else scanned
    symbols = cut(numbered(whole.where(F.col("kind").isin(*INDEXED))))
    posted = I.postings(I.declaration_terms(symbols))
    words = cut(posted.groupBy("term").agg(F.count_distinct("symbol_id").alias("df"), F.sum("tf").alias("n")))
    compounds = cut(T.segmented(words, words.select("term", "n")))
    posted = cut(I.refined(posted, compounds))
    stats = cut(I.frequencies(posted))
    total = symbols.count()
    calls = call_tables(symbols)
    calls = (cut(calls[0]), *calls[1:])
    edges = cut(G.contains_edges(symbols).unionByName(G.call_edges(*calls)))
    outcomes = {r.outcome: r.n for r in G.call_outcomes(*calls).collect()}
    drawn = {r.kind: r["count"] for r in edges.groupBy("kind").count().collect()}
    vocabulary = I.with_icf(stats, total).where(F.col("term").rlike("^[a-z]+$"))
    pairs = GR.lexical_pairs(vocabulary.select(F.col("term").alias("word")), GR.discriminating(vocabulary, total))
    expansion = GR.top_targets(pairs)
    if direct_annotations is None and "java" in languages:
        direct_annotations = java_facts.direct_annotations(spark)
    if direct_annotations is not None:
        expansion = expansion.unionByName(GR.meta_closure(direct_annotations).withColumn("ord", F.lit(0)))
    shown = symbols.select("symbol_id", "name", "kind", "file", "span", "signature", "container", F.col("language") if "language" in symbols.columns else F.lit("").alias("language"), F.substring("doc", 1, 400).alias("doc"), F.array_sort(F.array_distinct("modifiers")).alias("modifiers"))
    built = {
        "symbols": total,
        "annotations": symbols.agg(F.coalesce(F.sum(F.size("annotations")), F.lit(0))).first()[0] if "annotations" in symbols.columns else 0,
        "contains": drawn.get("contains", 0),
        "calls": drawn.get("calls", 0),
        "segmented": compounds.count(),
        **{k: outcomes.get(k, 0) for k in ("typed", "named", "ambiguous", "unresolved")},
    }
    meta = {"project": name, "languages": languages, "failed_files": failed, "files": symbols.select("file").distinct().count(), "built": built}
    return store.save(path, {"symbols": shown, "postings": posted, "stats": stats, "edges": edges, "expansion": expansion}, meta)


class Project:
    """An index opened for queries; its context is made once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = store.load(spark, path)[1]
        self.context: Context = store.context(spark, path)

    def search(self, query: str, **options: object) -> SearchResult:
        return search(query, self.context, **options)

    def describe(self) -> dict:
        kinds = {r.kind: r["count"] for r in self.context.symbols.groupBy("kind").count().collect()}
        return {**self.meta, "kinds": kinds}
