"""The whole chain: keywords, two searches, two answers, one synthesis, for a table of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import DIMS, embed
from ..functions.generation import ANSWERING, Factory, Sampling, generate
from ..functions.prompts import PromptSet, PromptVariant, chosen, render
from ..functions.text import PARAGRAPH_DELIMITER
from ..operators.contexts import article_body, context_windows, merge_windows, pair_answers
from ..operators.knn import PARAGRAPHS_PER_QUESTION, exact_knn
from ..operators.lexical_index import LexicalIndex
from ..operators.lexical_search import ARTICLES_PER_QUESTION, lexical_retrieve
from ..operators.paragraphs import paragraph_to_text
from ..operators.quantize import quantize
from ..session import cut, sized
from ..sources.tables import write_table

# Fixed values.
NO_QUESTION = "No user question found."
ANSWER_HEAD = "Answer:\n "

# A retriever maps questions(qid, question) to hits(qid, .., rank, page_content).
Retriever = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class VectorIndex:
    """Paragraph vectors ``id, qv``, the calibration they were quantized with, and the articles
    their texts are cut from."""

    vectors: DataFrame
    calibration: DataFrame
    articles: DataFrame
    delimiter: str = PARAGRAPH_DELIMITER
    encoder: Callable | None = None
    dims: int = DIMS


def embed_questions(questions: DataFrame, index: VectorIndex) -> DataFrame:
    """(qid, qv): questions encoded like the corpus and quantized with its calibration."""
    raw = embed(questions, "qid", "question", index.encoder, index.dims)
    return quantize(raw, index.calibration).withColumnRenamed("id", "qid")


def lexical_retriever(index: LexicalIndex, k: int = ARTICLES_PER_QUESTION) -> Retriever:
    return lambda questions: lexical_retrieve(questions, index, k)


def semantic_retrieve(questions: DataFrame, index: VectorIndex, k: int = PARAGRAPHS_PER_QUESTION,
                      **how) -> DataFrame:
    """(qid, paragraph_id, score, rank, page_content): nearest paragraphs with their text."""
    # an encoder runs once, and so does the search
    hits = cut(exact_knn(cut(embed_questions(questions, index)), index.vectors, k, **how))
    found = paragraph_to_text(hits.withColumnRenamed("id", "paragraph_id"), index.articles, index.delimiter)
    return found.select("qid", "paragraph_id", "score", "rank",
                        F.struct(F.lit("").alias("title"), F.col("paragraph").alias("text")).alias("page_content"))


def semantic_retriever(index: VectorIndex, k: int = PARAGRAPHS_PER_QUESTION) -> Retriever:
    return lambda questions: semantic_retrieve(questions, index, k)


def _windows(searched: DataFrame, retriever: Retriever, body: Column) -> DataFrame:
    """(qid, rank, window_no, context) of the hits. A text that many questions share is searched once,
    under its lowest qid."""
    once = cut(searched.groupBy("question").agg(F.min("qid").alias("first")))
    found = cut(context_windows(retriever(once.withColumnRenamed("first", "qid")), body))
    keyed = searched.join(sized(once, ["question", "first"]), "question").select("qid", "first")
    return keyed.join(found.withColumnRenamed("qid", "first"), "first").drop("first")


def _window_answers(asked: DataFrame, windows: DataFrame, template, factory, sampling: Sampling, variant: str | None,
                    out: str) -> DataFrame:
    """(qid, <out>): the context prompt is filled and answered for every window of the hits, and the
    best supported answer is kept. No hits, one empty context."""
    rows = asked.join(windows, "qid", "left")
    rows = rows.select("qid", "rank", "window_no", "question", "context", *([variant] if variant else []),
                       render(template, F.col("context"), F.col("question")).alias("prompt"))
    return merge_windows(generate(rows, factory, out=out, sampling=sampling, variant=variant), answer=out)


def answer_questions(questions: DataFrame, lexical: Retriever, semantic: Retriever,
                     factory: Factory | dict[str, Factory], prompts: PromptSet = PromptSet(),
                     variants: list[PromptVariant] = (), sampling: Sampling = ANSWERING) -> DataFrame:
    """(qid, lexical_answer, semantic_answer, combined_answer, output), written by a caller's model.

    ``questions(qid, question[, variant])``. ``factory`` makes the model, or names one for each variant
    (and ``default``). The two searches are independent branches; whole texts reach the model, in
    windows. What a model wrote is computed once, into the shared folder.
    """
    variant = "variant" if "variant" in questions.columns else None
    asked = questions.withColumn("question", F.coalesce("question", F.lit(NO_QUESTION)))

    def template(kind: str):
        return chosen(prompts, kind, variants, F.col(variant) if variant else None)

    extra = [variant] if variant else []
    to_search = asked.select("qid", *extra, render(template("lexical"), F.col("question")).alias("prompt"))
    keywords = generate(to_search, factory, out="question", sampling=sampling, variant=variant).select("qid", "question")
    lexical_answers = _window_answers(
        asked, _windows(keywords, lexical, article_body()),
        template("context"), factory, sampling, variant, "lexical_answer")
    semantic_answers = _window_answers(
        asked, _windows(asked.select("qid", "question"), semantic, F.col("page_content.text")),
        template("context"), factory, sampling, variant, "semantic_answer")
    paired = pair_answers(lexical_answers, semantic_answers)
    rows = paired.join(asked, "qid").select(
        *paired.columns, *extra,
        render(template("synthesis"), F.col("lexical_answer"), F.col("semantic_answer"), F.col("question"))
        .alias("prompt"))
    return (generate(rows, factory, out="combined_answer", sampling=sampling, variant=variant).drop(*extra)
            .withColumn("output", F.concat(F.lit(ANSWER_HEAD), F.col("combined_answer"))))


def write_answers(answers: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Answer sink; returns what was written, as read back, so that the chain runs once."""
    write_table(answers, path, mode)
    return answers.sparkSession.read.schema(answers.schema).parquet(path)
