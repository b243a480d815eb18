"""Contexts for prompts, rendered conversations, paired answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import DEFAULT_TOKENS, RoleTokens, chat_turn
from ..functions.text import prefix, tokens, windows

# Turns of one rendered block of a conversation.
TURNS_PER_BLOCK = 1024
# Pieces between blanks that a window of a context holds, and shares with the one before.
WINDOW_WORDS = 1500
WINDOW_OVERLAP = 100


def article_body(content: str = "page_content") -> Column:
    """An article as context text: its title, then its text."""
    return F.concat(F.coalesce(F.col(f"{content}.title"), F.lit("")), F.lit("\n"),
                    F.coalesce(F.col(f"{content}.text"), F.lit("")))


def build_context(hits: DataFrame, body: Column, chars: int | None = None, separator: str = "") -> DataFrame:
    """(qid, context): the whole bodies of a question's hits in rank order; ``chars`` may cut each.

    Hits come from a top-k search, so a group holds k rows.
    """
    rows = hits.select("qid", F.struct("rank", (body if chars is None else prefix(body, chars)).alias("body")).alias("hit"))
    ordered = F.transform(F.array_sort(F.collect_list("hit")), lambda h: h["body"])
    return rows.groupBy("qid").agg(F.array_join(ordered, separator).alias("context"))


def context_windows(hits: DataFrame, body: Column, size: int = WINDOW_WORDS,
                    overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """(qid, rank, window_no, context): the bodies of the hits in overlapping windows that a prompt
    can hold. No text is cut off: what is long has more windows."""
    return hits.select("qid", "rank", F.posexplode(windows(body, size, overlap)).alias("window_no", "context"))


def merge_windows(answers: DataFrame, question: str = "question", context: str = "context",
                  answer: str = "answer") -> DataFrame:
    """(qid, answer) from ``qid, rank, window_no`` and the named columns: the answer of the window that
    holds most different words of the question; of equal ones the first."""
    support = F.size(F.array_intersect(tokens(F.coalesce(context, F.lit(""))), tokens(F.coalesce(question, F.lit("")))))
    best = F.max(F.struct(support.alias("support"), (-F.coalesce("rank", F.lit(0))).alias("near"),
                          (-F.coalesce("window_no", F.lit(0))).alias("early"), F.col(answer).alias("answer")))
    return answers.groupBy("qid").agg(best.alias("b")).select("qid", F.col("b.answer").alias(answer))


def render_chat(turns: DataFrame, tokens: RoleTokens = DEFAULT_TOKENS,
                turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """(conv_id, block, turns, chat): conversations as prompt text, in blocks of turns.

    ``turn`` numbers the rows of a conversation. A block covers a fixed range of turn numbers,
    so even a conversation that holds most of the table is rendered by many tasks.
    """
    block = F.floor(F.col("turn") / turns_per_block).cast("long").alias("block")
    rows = turns.select("conv_id", block, F.struct(
        "turn", chat_turn(F.col("role"), F.col("text"), tokens).alias("text")).alias("said"))
    ordered = F.transform(F.array_sort(F.collect_list("said")), lambda s: s["text"])
    return rows.groupBy("conv_id", "block").agg(
        F.count("*").alias("turns"), F.array_join(ordered, "").alias("chat"))


def pair_answers(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """(qid, lexical_answer, semantic_answer); an answer only one side has meets an empty one."""
    return (lexical.select("qid", "lexical_answer")
            .join(semantic.select("qid", "semantic_answer"), "qid", "full")
            .select("qid", F.coalesce("lexical_answer", F.lit("")).alias("lexical_answer"),
                    F.coalesce("semantic_answer", F.lit("")).alias("semantic_answer")))
