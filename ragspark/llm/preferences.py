"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of a pair is rendered once as the prompt; what follows on either
side is a completion. Turns are matched by their number: the prefix ends before the first number
at which the sides differ, be it by role, by text, or because one side has no such turn. Completions
carry the spans that a loss counts: the texts of assistant turns with their end mark.

A pair is never gathered in one place: turns meet by pair and number, and text is rendered in blocks
of ``BLOCK`` turn numbers, in which a part of a pair is usually a single row. Rows of one number
and conversation are one turn, repeated rows once, otherwise ordered by role and text. Null roles are
``user``, null texts empty; rows without conversation or turn number are not part of any
conversation. A conversation without a partner is compared with an empty one.

Very long conversations come out in several rows of a part, very long texts within their row. An
empty table gives an empty result; columns besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import sized
from .common import stored

#: Turn numbers of one output row.
BLOCK = 256


def paired_neighbours(turns: DataFrame) -> DataFrame:
    """Conversation 2k is the chosen, 2k + 1 the rejected side of pair k."""
    conv = F.col("conv_id").cast("long")
    return turns.select(F.floor(conv / 2).cast("long").alias("pair_id"), (F.pmod(conv, F.lit(2)) == 0).alias("is_chosen"),
                        F.col("turn").cast("long").alias("turn"), "role", "text")


def swapped_endings(turns: DataFrame) -> DataFrame:
    """A pair for each conversation: as it is, and with its last assistant turn answered by that of its
    neighbour (2k and 2k + 1 are neighbours; without one, or without such a turn there, by nothing).

    Only the endings travel: one row for each conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ending = F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))
    ends = (rows.where("role = 'assistant' and pair_id is not null and turn is not null")
            .groupBy("pair_id").agg(ending.alias("e")).select("pair_id", F.col("e.turn").alias("last"), "e.text"))
    ends = stored(ends, "preference-endings")
    other = ends.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("text").alias("answer"))
    swaps = ends.select("pair_id", "last").join(other, "pair_id", "left").select(
        "pair_id", "last", F.coalesce("answer", F.lit("")).alias("answer"))
    both = rows.join(sized(swaps, ["pair_id", "last", "answer"], 16 << 20), "pair_id", "left").withColumn(
        "is_chosen", F.explode(F.array(F.lit(True), F.lit(False))))
    swapped = ~F.col("is_chosen") & (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    return both.select("pair_id", "is_chosen", "turn", "role",
                       F.when(swapped, F.col("answer")).otherwise(F.col("text")).alias("text"))


def preference_pairs(sides: DataFrame, block: int = BLOCK) -> DataFrame:
    """``pair_id, part`` (prompt, chosen, rejected), ``block, first_turn, n_turns, text, mask``.

    ``sides``: ``pair_id, is_chosen, turn, role, text``. ``mask`` lists ``start:length`` of the
    counted spans, in code points of ``text``."""
    rows = (sides.where("pair_id is not null and turn is not null")
            .select("pair_id", "is_chosen", "turn", F.coalesce("role", F.lit("user")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text")).distinct())
    said = rows.select("pair_id", "is_chosen", "turn", "role",
                       F.concat(F.lit("<|"), "role", F.lit("|>\n")).alias("head"),
                       F.concat("text", F.lit("<|end|>\n")).alias("body"))
    turns = said.groupBy("pair_id", "turn", "is_chosen").agg(
        F.sort_array(F.collect_list(F.struct("role", "head", "body"))).alias("said"))
    both = turns.groupBy("pair_id", "turn").agg(
        F.max(F.when(F.col("is_chosen"), F.col("said"))).alias("chosen"),
        F.max(F.when(~F.col("is_chosen"), F.col("said"))).alias("rejected"))
    both = stored(both, "preference-turns")
    split = both.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(
        F.min("turn").alias("end"))
    marked = both.join(sized(split, ["pair_id", "end"], 16 << 20), "pair_id", "left")
    shared = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    parts = marked.select("pair_id", "turn", F.explode(F.when(
        shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said")))).otherwise(F.array(
            F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("said")),
            F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("said"))))).alias("p"))
    parts = parts.select("pair_id", "turn", "p.part", "p.said").where("said is not null")
    grouped = parts.groupBy("pair_id", "part", F.floor(F.col("turn") / block).cast("long").alias("block")).agg(
        F.min("turn").alias("first_turn"), F.count("*").alias("n_turns"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"])).alias("said"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s, x):
        body = s["at"] + F.length(x["head"])
        counted = F.when(x["role"] == "assistant", F.array(F.concat(
            body.cast("string"), F.lit(":"), F.length(x["body"]).cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((body + F.length(x["body"])).cast("long").alias("at"), F.concat(s["spans"], counted).alias("spans"))

    spans = F.aggregate("said", start, step, lambda s: s["spans"])
    return grouped.select(
        "pair_id", "part", "block", "first_turn", "n_turns",
        F.array_join(F.transform("said", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        F.when(F.col("part") == "prompt", F.lit("")).otherwise(F.array_join(spans, ",")).alias("mask"))
