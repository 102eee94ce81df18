"""Agent traces: reading, episodes of searches, prompts from prefixes, and valid queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACE = "repo string, language string, instance_id string, trajectory_id string, base_commit string, trajectory array<struct<role:string,content:string,name:string,type:string,tool_calls:string>>"


def read_traces(spark: SparkSession, path: str, language: str = "Java", strict: bool = False) -> DataFrame:
    """One row for each event: trajectory_id, turn, role, tool and text.

    Content is a string, or a JSON list of blocks whose texts are joined.
    Records that are broken, lack an id or are of another language are left out,
    and ``trace_errors`` lists them; with ``strict`` the first of them raises.
    """
    if strict and (bad := trace_errors(spark, path, language).orderBy("file", "line").first()):
        raise ValueError(f"{bad.file}, line {bad.line}: {bad.error}")
    raw = spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)
    rows = raw.where((F.lower("language") == language.lower()) & F.col("trajectory_id").isNotNull() & F.col("trajectory").isNotNull())
    events = rows.select("repo", "instance_id", "trajectory_id", F.posexplode("trajectory").alias("turn", "e"))
    blocks = F.from_json("e.content", "array<struct<type:string,text:string,name:string>>")
    text = F.coalesce(F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull()), "\n"), F.col("e.content"))
    return events.select("repo", "instance_id", "trajectory_id", "turn", F.col("e.role").alias("role"), F.coalesce("e.name", F.get_json_object("e.tool_calls", "$[0].function.name")).alias("tool"), text.alias("text"))


def trace_errors(spark: SparkSession, path: str, language: str = "Java") -> DataFrame:
    """file, line (from 1) and error of each record that is no trace of the language; blank lines count and are no error.

    Files are read in splits: a line's number is its place in its split after
    the lines of the splits before, of which only the counts are gathered.
    """
    at = F.monotonically_increasing_id()
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", at)
    record = F.try_parse_json("value")
    text = lambda name: F.coalesce(F.trim(F.try_variant_get(record, f"$.{name}", "string")), F.lit(""))
    error = F.when(record.isNull(), "invalid JSON").when(~F.schema_of_variant(record).startswith("OBJECT"), "no JSON object")
    error = error.when(text("language") == "", "missing language").when(F.lower(text("language")) != language.lower(), F.concat(F.lit(f"no {language} trace: "), text("language")))
    for name in ("repo", "instance_id", "trajectory_id"):
        error = error.when(text(name) == "", f"missing {name}")
    turns = F.try_variant_get(record, "$.trajectory", "array<variant>")
    error = error.when(F.coalesce(F.size(turns), F.lit(0)) <= 0, "no trajectory")
    bad = raw.where(F.trim("value") != "").withColumn("error", error).where("error IS NOT NULL").select("file", "block", "at", "error")
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    return bad.join(blocks.withColumn("before", before), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "error")


def episode_tokens(text: Column, paths: Column | None = None) -> Column:
    """Distinct lower-case words of three characters or more, without those of paths."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z][a-zA-Z0-9_-]{2,}"), F.lit(0)), F.lower))
    return found if paths is None else F.array_except(found, paths)


def episodes(searches: DataFrame, gap: int = 2, overlap: float = 0.5) -> DataFrame:
    """``searches(conv_id, turn, tool, tokens)`` with episode numbers from 1.

    A search continues an episode if it comes at most ``gap`` turns after the
    one before, with the same tool and a share ``overlap`` of the smaller token set.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = lambda c: F.lag(c).over(order)
    least = F.least(F.size("tokens"), F.size(before("tokens")))
    joins = (F.col("turn") - before("turn") <= gap) & (F.col("tool") == before("tool")) & (least > 0) & (F.size(F.array_intersect("tokens", before("tokens"))) >= overlap * least)
    fresh = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    return searches.withColumn("fresh", fresh).withColumn("episode", F.sum("fresh").over(order)).drop("fresh")


def prefixes(turns: DataFrame) -> DataFrame:
    """What comes before each turn of ``turns(conv_id, turn, role, text)``, tool output left out: its number, length and text."""
    own = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    kept = turns.where("role <> 'tool'")
    return kept.select("conv_id", "turn", F.count("text").over(own).alias("before"), F.coalesce(F.sum(F.length("text")).over(own), F.lit(0)).alias("chars"), F.array_join(F.collect_list("text").over(own), "\n").alias("prompt"))


def valid_query(text: Column) -> Column:
    """A query worth asking: one line, no code marks, no absolute paths, no search commands."""
    text = F.coalesce(F.get_json_object(text, "$.query"), text)
    return (F.trim(text) != "") & ~text.rlike("[\n`]") & ~text.rlike(r"(^|\s)/[A-Za-z]") & ~text.rlike(r"\b(rg|grep)\b")
