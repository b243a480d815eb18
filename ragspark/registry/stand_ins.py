"""Settings and deterministic inputs of registered queries, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import PromptVariant
from ..functions.text import first_line
from ..plans.reading import Reader

# Prompt overrides used by registered queries.
VARIANTS = [
    PromptVariant("plain", "context", ("Context:\n", "\n<|user|>\n", "<|end|>\n")),
    PromptVariant("short", "lexical", ("Keywords for:\n<|user|>\n", "<|end|>\n")),
]
# Readers that registered evaluations compare.
READERS = (Reader(), Reader("three keywords", keywords=3), Reader("narrow", keywords=6, articles=1, paragraphs=3))


def model_outputs(documents: DataFrame) -> DataFrame:
    """(doc_id, output): three lines per document, the middle one sound or damaged by ``doc_id % 8``."""
    title, k = first_line(F.col("text")), F.col("doc_id") % 8
    good = F.to_json(F.struct(title.alias("question"), F.col("lang").alias("answer")))
    by_id = F.to_json(F.struct("doc_id", title.alias("question")).cast("struct<article_id: bigint, question: string>"))
    middle = (F.when(k == 0, F.concat(good, F.lit(",")))
              .when(k == 1, F.concat(F.lit("["), F.substring(good, F.lit(2), F.length(good) - 2), F.lit("]")))
              .when(k == 2, F.concat(good, F.lit(" trailing")))
              .when(k == 3, F.to_json(F.struct(title.alias("Question"), F.col("lang").alias("answer"))))
              .when(k == 4, F.concat(F.lit(" ,"), good))
              .when(k == 5, by_id)
              .when(k == 6, F.substring(good, F.lit(1), F.length(good) - 1))
              .otherwise(F.concat(F.lit('"'), F.replace(good, F.lit('"'), F.lit('\\"')), F.lit('"'))))
    return documents.select("doc_id", F.concat(
        F.lit("\nHere are the lines:\n"), middle, F.lit("\nnull\n")).alias("output"))
