"""The inverted index: declaration terms, postings, document frequencies and inverse frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.functions import text as T


def _declared(symbols: DataFrame, doc: str, doc_words: int | None) -> Column:
    """An array of (term, field), one for each occurrence."""
    parts: list[Column] = []
    have = set(symbols.columns)

    def add(field: str, words: Column) -> None:
        parts.append(F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(field).alias("field"))))

    for field in ("name", "container", "signature"):
        if field in have:
            add(field, T.split_identifier(field))
    if doc in have:
        add("doc", T.words_of(doc, doc_words))
    if "modifiers" in have:
        add("modifier", F.transform(F.coalesce("modifiers", F.array().cast("array<string>")), F.lower))
    if "annotations" in have:
        none = F.array().cast("array<struct<name:string,args:string>>")
        notes = F.coalesce("annotations", none)
        add("annotation", F.flatten(F.transform(notes, lambda a: F.concat(F.array(F.concat(F.lit("@"), a["name"])), T.split_identifier(a["name"])))))
        add("annotation_arg", F.flatten(F.transform(notes, lambda a: T.argument_tokens(a["args"]))))
    return F.concat(*parts)


def declaration_terms(symbols: DataFrame, doc: str = "doc", doc_words: int | None = None) -> DataFrame:
    """One row for each (term, field) occurrence of ``symbols``; missing columns give nothing, and docs all words unless told otherwise."""
    return symbols.select("symbol_id", F.explode(_declared(symbols, doc, doc_words)).alias("t")).select("t.term", "symbol_id", "t.field")


def symbol_frequencies(symbols: DataFrame, doc: str = "doc", doc_words: int | None = None) -> DataFrame:
    """term and df as ``frequencies`` of the postings has them, without these: a symbol of one row counts its own distinct terms."""
    again = symbols.groupBy("symbol_id").agg(F.count("*").alias("n")).where("n > 1").select("symbol_id")
    terms = F.explode(F.array_distinct(F.transform(_declared(symbols, doc, doc_words), lambda t: t["term"]))).alias("term")
    once = symbols.join(again, "symbol_id", "left_anti").select(terms).groupBy("term").agg(F.count("*").alias("df"))
    more = symbols.join(again, "symbol_id", "left_semi").select("symbol_id", terms).groupBy("term").agg(F.count_distinct("symbol_id").alias("df"))
    return once.unionByName(more).groupBy("term").agg(F.sum("df").alias("df"))


def postings(terms: DataFrame) -> DataFrame:
    """term, symbol_id, field and tf: combined on the map side, shuffled once."""
    return terms.groupBy("term", "symbol_id", "field").agg(F.count("*").alias("tf"))


def frequencies(posted: DataFrame) -> DataFrame:
    """Distinct symbols of each term over all fields."""
    return posted.groupBy("term").agg(F.count_distinct("symbol_id").alias("df"))


def with_icf(stats: DataFrame, total: int) -> DataFrame:
    """Adds icf = ln(N / df) and its share of ln N; both 0 where they have no sense."""
    n = F.lit(float(total))
    ok = (F.col("df") > 0) & (n > 1)
    icf = F.when(ok, F.ln(n / F.col("df"))).otherwise(0.0)
    return stats.withColumn("icf", icf).withColumn("icf_ratio", F.when(ok, icf / F.ln(n)).otherwise(0.0))


def refined(posted: DataFrame, pieces: DataFrame) -> DataFrame:
    """Postings and those that compounds lend to their pieces (term, pieces), from the table before refining."""
    lent = posted.join(pieces, "term").select(F.explode("pieces").alias("term"), "symbol_id", "field", "tf")
    return posted.unionByName(lent).groupBy("term", "symbol_id", "field").agg(F.sum("tf").alias("tf"))


def vocabulary(stats: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = stats.select("term", "df").orderBy(F.desc("df"), "term")
    return ordered if limit is None else ordered.limit(limit)


def corpus_sentences(symbols: DataFrame, doc_words: int = 60) -> DataFrame:
    """Distinct words of a symbol's name, container, signature, doc and annotations; two words at least."""
    have = [T.split_identifier(c) for c in ("name", "container", "signature") if c in symbols.columns]
    have.append(T.words_of("doc", doc_words))
    if "annotations" in symbols.columns:
        notes = F.coalesce("annotations", F.array().cast("array<struct<name:string,args:string>>"))
        have.append(F.flatten(F.transform(notes, lambda a: F.concat(T.split_identifier(a["name"]), T.argument_tokens(a["args"])))))
    words = F.array_distinct(F.concat(*have))
    return symbols.select("symbol_id", words.alias("words")).where(F.size("words") >= 2)


def code_tokens(texts: DataFrame, lexicon: DataFrame, english: DataFrame) -> DataFrame:
    """text and tokens of ``texts(text)``: pieces by case first; what that leaves whole and is no word of ``english(term)`` is segmented by ``lexicon(term, n)``."""
    cased = texts.select("text").distinct().withColumn("own", T.split_identifier("text"))
    only = F.when(F.size("own") == 1, F.try_element_at("own", F.lit(1)))
    whole = cased.select(only.alias("term")).where("term IS NOT NULL").distinct().join(english.select("term"), "term", "left_anti")
    pieces = T.segmented(whole, lexicon)
    return cased.withColumn("term", only).join(pieces, "term", "left").select("text", F.coalesce("pieces", "own").alias("tokens"))
