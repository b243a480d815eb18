"""Paragraphs and lookups by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PARAGRAPH_DELIMITER, article_part, number_part, paragraph_id, pieces
from ..session import needed


def split_paragraphs(articles: DataFrame, delimiter: str = PARAGRAPH_DELIMITER, keep: list[str] = ()) -> DataFrame:
    """(*keep, paragraph_id, article_id, paragraph_no, paragraph), one row per piece."""
    return (articles
            .select(*keep, "article_id", F.posexplode(pieces(F.col("text"), delimiter))
                    .alias("paragraph_no", "paragraph"))
            .select(*keep, paragraph_id(F.col("article_id"), F.col("paragraph_no")).alias("paragraph_id"),
                    "article_id", "paragraph_no", "paragraph"))


def parse_ids(ids: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """Add ``article_id, paragraph_no``; the id takes the type it has in ``articles``."""
    article = article_part(F.col("paragraph_id"))
    if articles is not None:
        article = article.try_cast(articles.schema["article_id"].dataType)
    return ids.withColumns({"article_id": article, "paragraph_no": number_part(F.col("paragraph_id"))})


def paragraph_to_article(ids: DataFrame, articles: DataFrame) -> DataFrame:
    """Whole article of each paragraph id; ids of unknown articles drop out.

    Articles are first reduced to those asked for. Of the join that then attaches them, a
    popular article is split by the adaptive skew join.
    """
    wanted = parse_ids(ids, articles)
    return wanted.join(needed(articles, wanted, "article_id"), "article_id")


def paragraph_to_text(ids: DataFrame, articles: DataFrame,
                      delimiter: str = PARAGRAPH_DELIMITER) -> DataFrame:
    """Add ``paragraph``: the numbered piece of the article, null past its end."""
    text = F.get(pieces(F.col("text"), delimiter), F.col("paragraph_no"))
    wanted = parse_ids(ids, articles)
    texts = needed(articles.select("article_id", "text"), wanted, "article_id")
    return (wanted.join(texts, "article_id", "left")
            .withColumn("paragraph", text).select(*wanted.columns, "paragraph"))


def get_by_id(ids: DataFrame, articles: DataFrame) -> DataFrame:
    """Each asked ``article_id`` with its article, ``found`` telling whether there is one."""
    kept = needed(articles, ids, "article_id").withColumn("_there", F.lit(True))
    return (ids.join(kept, "article_id", "left")
            .withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there"))
