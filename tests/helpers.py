"""Small corpora and a DuckDB twin of the tables."""

from __future__ import annotations

import math

import duckdb

from fragmill.model import EDGES, EXPANSION, POSTINGS, Context

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def graph(spark, edges, ids=None, total=100):
    """A context of numbered symbols and edges (src, dst[, kind[, confidence]])."""
    rows = [(a, b, kind, None, conf, "test") for a, b, kind, conf in ((*e, *("calls", 1.0)[len(e) - 2 :]) for e in edges)]
    ids = sorted(ids if ids is not None else {x for e in edges for x in e[:2]})
    symbols = spark.createDataFrame([(i, f"n{i}", "class" if i % 3 == 0 else "method", "f") for i in ids], "symbol_id long, name string, kind string, file string")
    return Context(symbols, spark.createDataFrame([], POSTINGS), edges=spark.createDataFrame(rows, EDGES), total_override=total)


def corpus(spark, postings, total, expansion=(), ids=None):
    """A context of postings (term, symbol_id, field) in a corpus of ``total`` symbols."""
    ids = sorted(ids if ids is not None else {p[1] for p in postings})
    symbols = spark.createDataFrame([(i, f"n{i}", ("method", "class")[i % 3 == 0], "f") for i in ids], "symbol_id long, name string, kind string, file string")
    table = spark.createDataFrame([(t, i, f, 1) for t, i, f in postings], POSTINGS)
    more = spark.createDataFrame([(k, t, s, r, n) for n, (k, t, s, r) in enumerate(expansion)], EXPANSION)
    return Context(symbols, table, expansion=more, total_override=total)


def ids(frag):
    return sorted(r.symbol_id for r in frag.nodes.select("symbol_id").collect())


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or str(value) in ("<NA>", "NaT"):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(pandas_frame):
    columns = sorted(pandas_frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in pandas_frame[columns].itertuples(index=False)), key=str)
