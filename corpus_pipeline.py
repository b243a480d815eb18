"""From raw documents to encoded training text: five stages, each on all that the one before kept.

Toxic documents go; lines on many sites stay where they are seen first and go elsewhere; one
document of each group of near duplicates stays; documents that hold a benchmark passage go; the
rest is encoded. Every stage but the last returns the columns of ``documents``.

Null and empty texts pass all filters (they have no words to be judged by) and are encoded as nothing.
Rows without an id are judged by their text like any other. Of rows equal in id and text one
stays; of documents that tie as first of their group, that with the smaller id. Very long texts are
worked on whole by every stage. An empty table gives an empty result; columns of ``documents`` that a
stage does not know are kept up to the last. Without labels of both kinds no document counts as toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import jaccard_join, line_dedup, nbest_pieces, spaced_seeds, toxicity
from ragspark.llm.common import source, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, source(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean_lines(docs).drop("n_lines", "n_removed")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spaced_seeds.decontaminated(docs, source(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbest_pieces.digests(nbest_pieces.encode(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The first stage is learned and the last searches a lattice: SQL can state neither. The tests
#: hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written and read again."""
    docs = source(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
