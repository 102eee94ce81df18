"""The index directory: one Parquet table for each part, and meta.json last as the mark that it is whole."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.model import Context

FORMAT = 1
#: Hash buckets of terms: a query's few terms read a few files of the postings.
TERM_BUCKETS = 64


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target, fs = _hadoop(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    target, fs = _hadoop(spark, path)
    if not fs.exists(target):
        raise FileNotFoundError(f"no whole index: {path} is missing")
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def save(path: str, parts: dict[str, DataFrame], meta: dict) -> dict:
    """Writes ``parts`` (symbols, postings, stats, edges, expansion) and then the metadata."""
    spark = next(iter(parts.values())).sparkSession
    target, fs = _hadoop(spark, f"{path}/meta.json")
    fs.delete(target, False)
    counts = {}
    for name, df in parts.items():
        if "term" in df.columns:
            df = df.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % TERM_BUCKETS).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "term")
            df.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    meta = {**meta, "counts": counts, "built_at": datetime.now(timezone.utc).isoformat(), "format_version": FORMAT}
    _write_text(spark, f"{path}/meta.json", json.dumps(meta))
    return meta


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads(_read_text(spark, f"{path}/meta.json"))
    if meta.get("format_version") != FORMAT:
        raise ValueError(f"index format {meta.get('format_version')!r}, not {FORMAT}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["counts"]}, meta


def context(spark: SparkSession, path: str) -> Context:
    parts, meta = load(spark, path)
    return Context(parts["symbols"], parts["postings"], edges=parts.get("edges"), expansion=parts.get("expansion"), stats=parts.get("stats"), total_override=meta["counts"]["symbols"], buckets=TERM_BUCKETS)
