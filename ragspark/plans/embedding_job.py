"""The embedding job: articles to paragraph vectors in shards, which a later run takes up where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import DIMS, embed
from ..functions.text import PARAGRAPH_DELIMITER
from ..operators.paragraphs import split_paragraphs
from ..sources.articles import SHARDS, assign_shards, positions_by_key
from ..sources.tables import read_shards, table_exists, write_shards, write_table


def stage_articles(articles: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write the articles once, by shard, and read them back; what is there stays.

    Articles without ``article_seq`` get positions by the order of their ids, so a shard holds the same
    articles in every run. Later jobs read the folders of their shards only.
    """
    spark = articles.sparkSession
    if not table_exists(spark, path):
        if "article_seq" not in articles.columns:
            # an id twice in the corpus would meet both positions: one is kept
            places = positions_by_key(articles).groupBy("article_id").agg(F.min("article_seq").alias("article_seq"))
            articles = articles.join(places, "article_id")
        sharded = assign_shards(articles.select("article_id", "article_seq", "text"), shards)
        write_table(sharded.repartition("shard", F.pmod(F.xxhash64("article_id"), F.lit(8))), path, partition_by=["shard"])
    return spark.read.schema(f"article_id {articles.schema['article_id'].dataType.simpleString()}, article_seq BIGINT, "
                             "text STRING, shard INT").parquet(path)


def process_embeddings(articles: DataFrame, path: str, encoder: Callable | None = None, dims: int = DIMS,
                       delimiter: str = PARAGRAPH_DELIMITER, shards: int = SHARDS, shards_per_job: int = 4,
                       partitions: int | None = None) -> DataFrame:
    """(shard, id, embedding): vectors of all paragraphs of ``articles(article_id, text[, article_seq])``.

    The articles are staged by shard, then each job embeds a few shards and records them. Called again
    after a stop it goes on with the shards without a record; a finished job is only read.
    """
    staged = stage_articles(articles, f"{path}/articles", shards)

    def embedded(rows: DataFrame) -> DataFrame:
        keyed = split_paragraphs(rows, delimiter, keep=["shard"])
        made = embed(keyed.withColumn("key", F.struct("shard", "paragraph_id")), "key", "paragraph", encoder, dims, partitions)
        return made.select("id.shard", F.col("id.paragraph_id").alias("id"), "embedding")

    write_shards(staged, path, embedded, shards_per_job=shards_per_job)
    return read_shards(staged.sparkSession, path)
