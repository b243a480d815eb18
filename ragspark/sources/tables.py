"""Table sinks: guarded and idempotent writes, restartable sharded writes, keyed upserts,
snapshots with a manifest, JSON lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import byte_size, cut, pieces_of, sized

ROWS_PER_FILE = 1_000_000
ROW_GROUP_BYTES = 128 * 1024 * 1024
#: Bytes of one batch of a sized write.
BATCH_BYTES = 96 * 1024 * 1024

MANIFEST_SCHEMA = "snapshot STRING, table_name STRING, rows BIGINT, checksum DECIMAL(38,0)"


class MissingTableError(RuntimeError):
    """A table that should have been read is not there."""


def _hadoop_path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when a finished write is at ``path``."""
    fs, folder = _hadoop_path(spark, path)
    return fs.exists(folder.suffix("/_SUCCESS"))


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of what lies under ``root``, finished or not."""
    fs, folder = _hadoop_path(spark, root)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def finished_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders under ``root`` that hold a finished write."""
    return [n for n in folders(spark, root) if table_exists(spark, f"{root}/{n}")]


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet scan; a missing path is reported by name instead of as a planning error."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        raise MissingTableError(f"no table at {path}; write or download it first") from error


def first_table(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several locations that holds a table: working copy, then caches."""
    for path in paths:
        try:
            return read_table(spark, path)
        except MissingTableError:
            continue
    raise MissingTableError("no table at any of: " + ", ".join(paths))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=(),
                rows_per_file: int = ROWS_PER_FILE, row_group_bytes: int = ROW_GROUP_BYTES,
                compression: str = "zstd") -> None:
    """Parquet write with bounded files and row groups.

    ``mode='ignore'`` creates a table only where none is.
    """
    writer = (df.write.mode(mode)
              .option("compression", compression)
              .option("maxRecordsPerFile", rows_per_file)
              .option("parquet.block.size", row_group_bytes))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_sized(df: DataFrame, path: str, bytes_each: int = BATCH_BYTES, **how) -> int:
    """``write_table`` in partitions of about ``bytes_each``: the rows' bytes as text are counted first.

    ``df`` is read twice, so it should be a stored table. Returns the number of partitions.
    """
    n = pieces_of(df.agg(byte_size(*df.columns).alias("bytes")).first()["bytes"], bytes_each)
    write_table(df.repartition(n), path, **how)
    return n


def write_json_lines(objects: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, non-ASCII text unescaped, null members kept."""
    options = {"ignoreNullFields": "false"}
    objects.select(F.to_json(F.col(column), options).alias("value")).write.mode(mode).text(path)


# --- restartable sharded writes -------------------------------------------------------------

def shard_of(article_seq: Column, shard_rows) -> Column:
    return F.floor(article_seq / shard_rows).cast("int")


def pending_shards(rows: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows whose shard has no commit entry."""
    return rows.join(F.broadcast(committed.select("shard").distinct()), "shard", "left_anti")


def committed_shards(spark: SparkSession, path: str) -> DataFrame:
    if table_exists(spark, f"{path}/_commits"):
        return spark.read.parquet(f"{path}/_commits").select("shard")
    return spark.createDataFrame([], "shard INT")


def write_shards(rows: DataFrame, path: str, transform: Callable[[DataFrame], DataFrame],
                 shard_rows: int | None = None, shards_per_job: int = 4) -> list[int]:
    """Write ``transform(rows)`` by shard; finished shards are left alone.

    ``rows`` carries a ``shard`` column. Each job overwrites the partitions of a few shards and
    then records them in the commit table; a job that dies leaves no entry, so its shards are
    rewritten by the next run. A directory listing would take a half-written shard for done.
    With ``shard_rows`` the shards of a job are also asked for as ranges of ``article_seq``,
    which lets the scan skip files and row groups of other shards.
    Returns the shards written now.
    """
    spark = rows.sparkSession
    wanted = [r["shard"] for r in
              pending_shards(rows.select("shard").distinct(), committed_shards(spark, path))
              .orderBy("shard").collect()]  # one row per shard
    for at in range(0, len(wanted), shards_per_job):
        group = wanted[at:at + shards_per_job]
        mine = rows.where(F.col("shard").isin(group))
        if shard_rows is not None:
            mine = mine.where(reduce(or_, (
                F.col("article_seq").between(s * shard_rows, (s + 1) * shard_rows - 1) for s in group)))
        out = transform(mine)
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "zstd")
         .partitionBy("shard").parquet(f"{path}/data"))
        done = spark.createDataFrame([(s,) for s in group], "shard INT")
        done.coalesce(1).write.mode("append").parquet(f"{path}/_commits")
    return wanted


def read_shards(spark: SparkSession, *paths: str) -> DataFrame:
    """All committed shards of one or more sharded tables."""
    frames = [spark.read.parquet(f"{p}/data")
              .join(F.broadcast(committed_shards(spark, p).distinct()), "shard", "left_semi") for p in paths]
    return union_all(frames)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# --- keyed upsert ---------------------------------------------------------------------------

def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` rows replace ``old`` rows of the same key; the rest of both stays.

    Versions are told apart by a ``version`` column in ``new`` where it has one; of equal keys
    the highest version wins. The old table is not shuffled while the counted keys of the change fit
    a broadcast: its rows stay where they are, but for those replaced.
    """
    columns = old.columns
    version = F.col("version").cast("long") if "version" in new.columns else F.lit(1).cast("long")
    # an aggregate, not a window: versions combine before the shuffle, however many a key has
    newest = F.max_by(F.struct(*columns), F.struct(version, F.xxhash64(*columns)))
    changed = cut(new.groupBy(F.col(key).alias("_key")).agg(newest.alias("_row")).select("_row.*"))
    kept = old.join(sized(changed.select(key), [key]), old[key].eqNullSafe(changed[key]), "left_anti")
    return kept.select(*columns).unionByName(changed)


# --- snapshots ------------------------------------------------------------------------------

def row_checksum(df: DataFrame) -> Column:
    """32 bits of the md5 of a row's columns as text, null marked; order of rows is irrelevant."""
    marked = [F.coalesce(F.concat(F.lit("="), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))),
                         F.lit("-")) for c in df.columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *marked)), 1, 8), 16, 10).cast("decimal(20,0)")


def manifest_row(df: DataFrame, snapshot: str, table: str) -> DataFrame:
    """(snapshot, table_name, rows, checksum) of one table."""
    return df.agg(F.count("*").alias("rows"),
                  F.coalesce(F.sum(row_checksum(df)), F.lit(0)).cast("decimal(38,0)").alias("checksum")).select(
        F.lit(snapshot).alias("snapshot"), F.lit(table).alias("table_name"), "rows", "checksum")


def create_snapshot(tables: dict[str, DataFrame], root: str, name: str) -> DataFrame:
    """Copy tables to ``root/snapshot=name/`` and write their manifest last."""
    spark = next(iter(tables.values())).sparkSession
    base = f"{root}/snapshot={name}"
    for table, df in tables.items():
        write_table(df, f"{base}/{table}")
    copies = {table: spark.read.parquet(f"{base}/{table}") for table in tables}
    manifest = union_all([manifest_row(df, name, table) for table, df in copies.items()])
    write_table(manifest.coalesce(1), f"{base}/_manifest")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/_manifest")


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of all finished snapshots under ``root``."""
    fs, folder = _hadoop_path(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [f"{root}/{n}/_manifest" for n in names
            if n.startswith("snapshot=") and table_exists(spark, f"{root}/{n}/_manifest")]
    if not done:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(*done)


def restore_snapshot(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """Tables of a snapshot, checked against its manifest."""
    base = f"{root}/snapshot={name}"
    manifest = read_table(spark, f"{base}/_manifest", MANIFEST_SCHEMA).collect()  # one row per table
    tables = {r["table_name"]: spark.read.parquet(f"{base}/{r['table_name']}") for r in manifest}
    for row in manifest:
        found = manifest_row(tables[row["table_name"]], name, row["table_name"]).first()
        if (found["rows"], found["checksum"]) != (row["rows"], row["checksum"]):
            raise RuntimeError(f"snapshot {name}: table {row['table_name']} differs from its manifest")
    return tables
