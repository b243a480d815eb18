"""Article corpus: readers, positions, positional slices, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.text import first_line
from ..session import cut, parallel
from .tables import read_table, shard_of

ARTICLE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
])
DOCUMENT_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
VECTOR_SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"

# Fixed value: the reference job cuts its corpus into this many shards.
SHARDS = 28


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """``article_id, url, title, text`` from a published corpus."""
    return read_table(spark, path, ARTICLE_SCHEMA).withColumnRenamed("id", "article_id")


def documents_as_articles(spark: SparkSession, path: str) -> DataFrame:
    """``article_id, article_seq, title, text`` from a table of untitled numbered documents.

    The ids are 0-based without gaps, so they are positions too. The title is the first line.
    """
    return read_table(spark, path, DOCUMENT_SCHEMA).select(
        F.col("doc_id").alias("article_id"), F.col("doc_id").alias("article_seq"),
        first_line(F.col("text")).alias("title"), "text")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``id, embedding``."""
    return read_table(spark, path, VECTOR_SCHEMA).select(F.col("vec_id").alias("id"), "embedding")


def with_positions(df: DataFrame) -> DataFrame:
    """Add ``article_seq``: 0-based positions in scan order, without a global sort.

    Each partition's rows are counted, and a partition's first position is the sum of the
    counts before it. Only those counts, one per partition, meet in one task. ``df`` must scan
    the same partitions each time it is computed, as file scans do.
    """
    marked = df.withColumn("_mark", F.monotonically_increasing_id())
    part = F.shiftright("_mark", 33).alias("_part")
    counts = marked.groupBy(part).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (marked.withColumn("_part", F.shiftright("_mark", 33))
            .join(F.broadcast(starts), "_part")  # one row per input partition
            .withColumn("article_seq", F.col("_start") + F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_mark", "_part", "_start"))


def positions_by_key(df: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, article_seq): 0-based positions in the order of ``key``, whatever files the rows lie in.

    Two passes over the keys alone: they are cut into ranges and sorted within them, once, into the
    shared folder; then the ranges are counted, and a range's first position is the sum of the counts
    before it. Only those counts meet in one task. Rows of equal keys have positions of their own.
    """
    keys = df.select(key).repartitionByRange(parallel(df.sparkSession), key).sortWithinPartitions(key)
    ranged = cut(keys.withColumn("_mark", F.monotonically_increasing_id()))
    part = F.shiftright("_mark", 33).alias("_part")
    counts = ranged.groupBy(part).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (ranged.withColumn("_part", F.shiftright("_mark", 33)).join(F.broadcast(starts), "_part")  # one row per range
            .select(key, (F.col("_start") + F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))).alias("article_seq")))


def prefix_rows(articles: DataFrame, n: int) -> DataFrame:
    """The first ``n`` articles by position."""
    return articles.orderBy("article_seq").limit(n)


def _percent_end(articles: DataFrame, percent: float) -> Column:
    return articles.agg(F.round(F.count("*") * F.lit(percent) / 100).cast("long")).scalar()


def prefix_percent(articles: DataFrame, percent: float) -> DataFrame:
    """The first ``percent`` of the articles by position; the end is rounded half up."""
    return articles.where(F.col("article_seq") < _percent_end(articles, percent))


def range_rows(articles: DataFrame, start: int, stop: int) -> DataFrame:
    """Articles ``start`` to ``stop - 1``; the bounds reach the file scan."""
    return articles.where(F.col("article_seq").between(start, stop - 1))


def assign_shards(articles: DataFrame, shards: int = SHARDS, shard_rows: int | None = None) -> DataFrame:
    """Add ``shard`` by position: ``shard_rows`` articles each, or ``shards`` equal parts."""
    if shard_rows is not None:
        return articles.withColumn("shard", shard_of(F.col("article_seq"), F.lit(shard_rows)))
    per_shard = articles.agg(F.greatest(F.ceil(F.count("*") / shards), F.lit(1)).alias("n")).scalar()
    return articles.withColumn("shard", shard_of(F.col("article_seq"), per_shard))
