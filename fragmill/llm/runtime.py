"""Session helpers shared by the operators: lineage cuts, sized joins, ids.

Lineage is cut with reliable checkpoints in the folder that the session names
in ``spark.checkpoint.dir``; a folder of our own is used only where that is
unset on one machine (tests), and on a cluster it is an error.  Spark deletes
checkpoints that nothing refers to any more if the session is started with
``spark.cleaner.referenceTracking.cleanCheckpoints``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that end a word under the whitespace rule, as a Java regex class.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of at most so many rows may be broadcast; rows are bounded in width by the callers.
BROADCAST_ROWS = 20_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fragmill-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows, written as Parquet to the shared checkpoint folder and read again, and where."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what ``written`` wrote, in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of an Arrow batch for Python workers, where the session leaves Spark's default.
BATCH_BYTES = 16 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def share_package(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, and get batches of bounded size.

    Where the session has Spark's default for the bytes of an Arrow batch, this
    sets it to ``BATCH_BYTES``, for the session; a value of the user's stays.
    """
    if spark.conf.get(_BATCH_KEY, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def uniform(*cols: Column | str) -> Column:
    """A reproducible number in [0, 1) from the values of ``cols``."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def sampled(h: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the first ``share`` of its range; 63 bits fine, so no share of a large table rounds to none."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(h, 1) < F.lit(int(max(share, 0.0) * 2.0**63))


def join_small(left: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 32, spread: Column | None = None) -> DataFrame:
    """``left`` joined to a table with one row for each key, without piling a hot key on one task.

    ``small`` must be cut already.  Up to ``BROADCAST_ROWS`` rows it is
    broadcast (its count is checked here); beyond that its rows are repeated
    ``salts`` times and ``left`` is dealt over the salts by ``spread``.
    Keys match null-safely; the key column is kept once.
    """
    other = small.withColumnRenamed(key, "__key")
    if small.count() <= BROADCAST_ROWS:
        out = left.join(F.broadcast(other), left[key].eqNullSafe(other["__key"]), how)
    else:
        salted = left.withColumn("__salt", F.pmod(spread if spread is not None else F.xxhash64(*left.columns), F.lit(salts)))
        other = other.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        out = salted.join(other, salted[key].eqNullSafe(other["__key"]) & (salted["__salt"] == other["__salt2"]), how).drop("__salt", "__salt2")
    return out.drop("__key")


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most ``BROADCAST_ROWS``; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ranked(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """``rows`` and their ranks from 0 in the order given, as a column rank; rows that tie in all of it in any order."""
    spark = rows.sparkSession
    place = F.monotonically_increasing_id()
    placed = cut(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("__place", place))
    part = F.shiftright("__place", 33)
    # One row for each partition: bounded by their number.
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), part == F.col("part")).withColumn("rank", F.col("before") + F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__place", "part", "before")
