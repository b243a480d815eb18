"""Session settings, the shared scratch folder, and size checks made before a broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A relation is broadcast only after its bytes were counted and found below this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app_name: str = "ragspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even where that costs one more shuffle downstream
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, because there driver and executors are one machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ragspark-"))
    # Spark appends a folder of its own to what was set; its parent is ours
    return os.path.dirname(sc.getCheckpointDir().replace("file:", "", 1).rstrip("/"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/ragspark/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and go on from there.

    Used where a result is read by several branches, or must not be computed twice because a
    model wrote it. The copy outlives lost executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallel(spark: SparkSession) -> int:
    """Tasks for costly work on few bytes, which the adaptive planner would put into one."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pieces_of(total: int, each: int) -> int:
    """How many pieces of ``each`` make up ``total``; at least one."""
    return max(1, -(-int(total) // int(each)))


def byte_size(*columns: str):
    """Aggregate: bytes of the named columns as text, plus a fixed cost per row."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(32))
    return F.coalesce(F.sum(width.cast("long")), F.lit(0))


def fits_broadcast(df: DataFrame, columns: list[str], limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Count the bytes of ``columns``; true when they are within ``limit``."""
    return df.agg(byte_size(*columns).alias("bytes")).first()["bytes"] <= limit


def sized(df: DataFrame, columns: list[str], limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its counted bytes are within ``limit``, else as it is."""
    return F.broadcast(df) if fits_broadcast(df, columns, limit) else df


def needed(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a large ``table`` whose ``key`` occurs in ``keys``.

    Left to its estimates the planner may shuffle the whole table before it learns how few rows
    are asked for. So the distinct keys are counted first: few are broadcast and the table is
    only scanned, many make it an ordinary semi join.
    """
    return table.join(sized(keys.select(key).distinct(), [key]), key, "left_semi")
