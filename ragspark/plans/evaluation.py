"""Evaluation: cases from questions, containment checks, runs over prompt variants, pass rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .answering import NO_QUESTION

CASE_SCHEMA = ("qid STRING, vars STRUCT<inquiry: STRING>, "
               "assert ARRAY<STRUCT<type: STRING, value: STRING>>")
# Fixed value: the only assertion the reference uses.
CONTAINS = "icontains"
# Name of the run without an override.
DEFAULT_VARIANT = "default"


def eval_cases(questions: DataFrame) -> DataFrame:
    """(qid, vars{inquiry}, assert[{type, value}]) from ``qid, question, answer``."""
    return questions.select(
        "qid", F.struct(F.col("question").alias("inquiry")).alias("vars"),
        F.array(F.struct(F.lit(CONTAINS).alias("type"), F.col("answer").alias("value"))).alias("assert"))


def write_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE_SCHEMA).json(path)


def passes(output: Column, assertions: Column) -> Column:
    """True when the output contains every expected value, whatever the case of letters."""
    held = F.forall(assertions, lambda a: F.contains(F.lower(output), F.lower(a["value"])))
    return F.coalesce(held, F.lit(False))


def score_cases(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Cases with their ``output`` and ``pass``; a case without output fails."""
    return cases.join(outputs, "qid", "left").withColumn("pass", passes(F.col("output"), F.col("assert")))


def with_variants(questions: DataFrame, names: list[str]) -> DataFrame:
    """Each question once per variant and once under the default.

    The variants are settings, so they are written into the plan; nothing is joined.
    """
    every = [DEFAULT_VARIANT, *(n for n in names if n != DEFAULT_VARIANT)]
    return questions.withColumn("variant", F.explode(F.array(*map(F.lit, every))))


def run_eval(cases: DataFrame, answer: Callable[[DataFrame], DataFrame], variants: list[str] = ()) -> DataFrame:
    """(qid, variant, output, pass) of every case under every variant.

    ``answer`` maps ``qid, question, variant`` to ``qid, output``: a model's chain
    (``answer_questions``) or a reader (``read_answers``).
    """
    run_id = F.concat_ws("/", F.col("variant"), F.col("qid").cast("string"))
    runs = with_variants(cases, list(variants)).withColumn("run_id", run_id)
    asked = runs.select(F.col("run_id").alias("qid"),
                        F.coalesce("vars.inquiry", F.lit(NO_QUESTION)).alias("question"), "variant")
    outputs = answer(asked).select(F.col("qid").alias("run_id"), "output")
    return (runs.join(outputs, "run_id", "left")
            .withColumn("pass", passes(F.col("output"), F.col("assert")))
            .select("qid", "variant", "output", "pass"))


def pass_rate(scored: DataFrame) -> DataFrame:
    """(variant, cases, passed, rate)."""
    return scored.groupBy("variant").agg(
        F.count("*").alias("cases"), F.count_if("pass").alias("passed"),
        F.round(F.avg(F.col("pass").cast("double")), 6).alias("rate"))
