"""Extractive reading: answers are sentences of the retrieved texts, chosen without any model.

Keywords are the question's rarest words. The retrieved texts are cut into sentences, all of them,
whole; each is scored by the summed rarity (idf) of the different question words it holds, and the
best of a question is kept by an aggregate: of equal ones that of the better ranked text, then the
earlier. The combined answer is the better of the two searches' sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, tokens
from ..operators.lexical_index import LexicalIndex
from ..operators.lexical_search import ARTICLES_PER_QUESTION, lexical_retrieve, question_terms
from ..operators.knn import PARAGRAPHS_PER_QUESTION
from ..session import cut, sized
from ..sources.tables import union_all
from .answering import ANSWER_HEAD, NO_QUESTION, VectorIndex, semantic_retrieve

SCORE_DIGITS = 6


@dataclass(frozen=True)
class Reader:
    """Settings of one way to read: how many keywords search (all when none is given), and how many
    articles and paragraphs are read."""

    name: str = "default"
    keywords: int | None = None
    articles: int = ARTICLES_PER_QUESTION
    paragraphs: int = PARAGRAPHS_PER_QUESTION


def rarity(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def rare_terms(questions: DataFrame, index: LexicalIndex, field: str = "text") -> DataFrame:
    """(qid, known): the question's words that the index has, as ``term, idf``, rarest first."""
    asked = question_terms(questions, (field,))
    known = (sized(asked, ["qid", "field", "term"]).join(index.doc_freq.select("field", "term", "df"), ["field", "term"])
             .join(F.broadcast(index.stats.select("field", "n")), "field")  # one row per field
             .select("qid", F.struct((-rarity(F.col("df"), F.col("n"))).alias("lightness"), "term").alias("t")))
    ordered = F.array_sort(F.collect_list("t"))  # the different words of one question
    return known.groupBy("qid").agg(F.transform(ordered, lambda t: F.struct(
        t["term"].alias("term"), (-t["lightness"]).alias("idf"))).alias("known"))


def keywords(questions: DataFrame, index: LexicalIndex, n: int | None = None) -> DataFrame:
    """(qid, question): the ``n`` rarest known words of each question, as a comma list."""
    return _comma_list(rare_terms(questions, index), n)


def _comma_list(known: DataFrame, n: int | None) -> DataFrame:
    chosen = F.col("known.term") if n is None else F.slice("known.term", 1, n)
    return known.select("qid", F.array_join(chosen, ", ").alias("question"))


def best_spans(questions: DataFrame, hits: DataFrame, index: LexicalIndex) -> DataFrame:
    """(qid, score, rank, span_no, span): the best sentence among the hits of each question.

    ``hits(qid, rank, page_content)``. Sentences without any known question word are no answer.
    """
    return _best_of(hits, rare_terms(questions, index))


def _best_of(hits: DataFrame, known: DataFrame) -> DataFrame:
    wanted = sized(known, ["qid", "known"])
    held = F.filter("known", lambda t: F.array_contains(F.col("words"), t["term"]))
    score = F.round(F.aggregate(held, F.lit(0.0), lambda s, t: s + t["idf"]), SCORE_DIGITS)
    scored = (hits.select("qid", "rank", F.posexplode(sentences(F.col("page_content.text"))).alias("span_no", "span"))
              .join(wanted, "qid")
              .withColumn("words", tokens(F.col("span"))).withColumn("score", score).where("score > 0"))
    best = scored.groupBy("qid").agg(F.max(F.struct(
        "score", (-F.col("rank")).alias("near"), (-F.col("span_no")).alias("early"), F.trim("span").alias("span"))).alias("b"))
    return best.select("qid", "b.score", (-F.col("b.near")).alias("rank"), (-F.col("b.early")).alias("span_no"), "b.span")


def _read(known: DataFrame, near: DataFrame, lexical: LexicalIndex, reader: Reader) -> DataFrame:
    """Answers of one reader to distinct questions, given as their known words and nearest paragraphs."""
    hits = lexical_retrieve(_comma_list(known, reader.keywords), lexical, reader.articles)
    left, right = _best_of(hits, known), _best_of(near.where(F.col("rank") <= reader.paragraphs), known)
    both = (left.select("qid", F.col("score").alias("l"), F.col("span").alias("lexical_answer"))
            .join(right.select("qid", F.col("score").alias("s"), F.col("span").alias("semantic_answer")), "qid", "full"))
    better = F.when(F.coalesce("l", F.lit(0.0)) >= F.coalesce("s", F.lit(0.0)), F.col("lexical_answer"))
    return both.select("qid", "lexical_answer", "semantic_answer",
                       better.otherwise(F.col("semantic_answer")).alias("combined_answer"))


def read_answers(questions: DataFrame, lexical: LexicalIndex, semantic: VectorIndex,
                 readers: tuple[Reader, ...] = (Reader(),)) -> DataFrame:
    """(qid, lexical_answer, semantic_answer, combined_answer, output) of ``questions(qid, question
    [, variant])``; a variant is the name of a reader, unknown ones read with the first.

    Equal questions are read once. Where nothing is found an answer is empty.
    """
    asked = questions.withColumn("question", F.coalesce("question", F.lit(NO_QUESTION)))
    names = [r.name for r in readers]
    variant = F.col("variant") if "variant" in questions.columns else F.lit(names[0])
    asked = cut(asked.select("qid", "question", F.when(variant.isin(names), variant).otherwise(names[0]).alias("reader")))
    once = cut(asked.groupBy("question").agg(F.min("qid").alias("qid"), F.collect_set("reader").alias("readers")))
    known = cut(rare_terms(once, lexical).join(once.select("qid", "readers"), "qid"))
    near = cut(semantic_retrieve(once.select("qid", "question"), semantic, max(r.paragraphs for r in readers)))
    found = union_all([
        _read(known.where(F.array_contains("readers", r.name)), near, lexical, r).withColumn("reader", F.lit(r.name))
        for r in readers])
    told = found.join(once.select("qid", "question"), "qid").drop("qid")
    answers = [F.coalesce(c, F.lit("")).alias(c) for c in ("lexical_answer", "semantic_answer", "combined_answer")]
    # a question that many ask is one row on this side
    return (asked.join(sized(cut(told), ["reader", "question", "lexical_answer", "semantic_answer"]), ["reader", "question"], "left")
            .select("qid", *answers)
            .withColumn("output", F.concat(F.lit(ANSWER_HEAD), F.col("combined_answer"))))
