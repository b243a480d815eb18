"""Templates, role tokens, contexts, conversations."""

from pyspark.sql import functions as F

from ragspark.functions import prompts
from ragspark.operators import contexts


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} STRING" for k in values))
    return df.select(column.alias("p")).first().p


def test_slots_are_not_parsed(spark):
    nasty = "{context} {user_question} %s \"' <|end|> $1 \\1"
    got = _one(spark, prompts.context_prompt(F.col("c"), F.col("q")), c=nasty, q=nasty)
    head, middle, tail = prompts.PromptSet().context
    assert got == head + nasty + middle + nasty + tail


def test_empty_context_and_search_prompt(spark):
    got = _one(spark, prompts.context_prompt(F.col("c"), F.col("q")), c=None, q="why?")
    assert "user's question:\n<|end|>\n<|user|>\nwhy?<|end|>\n<|assistant|>\n" in got
    got = _one(spark, prompts.search_prompt(F.col("q")), q="why?")
    assert got.startswith("<|system|>\nGive a comma-separated list")
    assert got.endswith("<|user|>\nwhy?<|end|>\n<|assistant|>\n")


def test_essay_prompt_holds_plain_json(spark):
    got = _one(spark, prompts.essay_prompt(F.col("i"), F.col("t"), F.col("x")), i="7", t="T", x="body")
    assert got.startswith("<|system|>\n7 T body\nGive five")
    assert got.endswith('<|user|>\n{"article_id": 7, "title": T, "text": body }<|end|>\n<|assistant|>')
    assert '{"article_id": "12", "question": "Describe three major criticisms of Anarchy" }' in got


def test_role_tokens_are_settings(spark):
    tokens = prompts.RoleTokens("[SYS]", "[U]", "[A]", "[E]")
    got = _one(spark, prompts.search_prompt(F.col("q"), tokens), q="why?")
    assert got.startswith("[SYS]\n") and "<|" not in got
    assert prompts.PromptSet.of(tokens).answer[0].startswith("[SYS]\nDirectly answer")


def test_override_by_kind(spark):
    mine = [prompts.PromptVariant("v", "synthesis", ("A:", "|B:", "|Q:", "."))]
    df = spark.createDataFrame([("v",), ("default",)], "variant STRING")
    template = prompts.chosen(prompts.PromptSet(), "synthesis", mine, F.col("variant"))
    got = [r.p for r in df.select(prompts.render(template, F.lit("l"), F.lit("s"), F.lit("q")).alias("p")).collect()]
    assert got[0] == "A:l|B:s|Q:q." and got[1].startswith("<|system|>")


def test_context_order_and_cut(spark):
    hits = spark.createDataFrame(
        [(1, 2, ("B", "bb")), (1, 1, ("A", "a" * 20)), (2, 1, (None, "x"))],
        "qid INT, rank INT, page_content STRUCT<title: STRING, text: STRING>")
    got = {r.qid: r.context for r in contexts.build_context(hits, contexts.article_body(), chars=5).collect()}
    assert got == {1: "A\naaa" + "B\nbb", 2: "\nx"}


def test_long_conversation_is_rendered_in_blocks(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(2500)] + [(2, 0, "system", "s")]
    turns = spark.createDataFrame(rows, "conv_id INT, turn BIGINT, role STRING, text STRING")
    got = {(r.conv_id, r.block): r for r in contexts.render_chat(turns).collect()}
    assert {k: r.turns for k, r in got.items()} == {(1, 0): 1024, (1, 1): 1024, (1, 2): 452, (2, 0): 1}
    assert got[2, 0].chat == "<|system|>\ns<|end|>\n"
    assert got[1, 0].chat.startswith("<|user|>\nt0<|end|>\n<|assistant|>\nt1<|end|>\n<|user|>\nt2")
