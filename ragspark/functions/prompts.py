"""Prompts as column expressions.

A template is a tuple of literal pieces with one slot between each two of them; rendering
concatenates pieces and slot columns. Nothing is parsed, so text that looks like a placeholder
or a role token passes through as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Template = tuple[str, ...]

# The wording of the five prompts. SYS, USER, BOT and END stand for the role
# tokens, SLOT for a column.
SYS, USER, BOT, END, SLOT = "\x00sys\x00", "\x00user\x00", "\x00bot\x00", "\x00end\x00", "\x00slot\x00"

SEARCH_TEXT = f"""{SYS}
Give a comma-separated list of search keywords most likely to find an answer to the user's question. Do NOT answer the question.{END}
{USER}
When was Obama born?{END}
{BOT}
Barack Obama,United States Presidents,Family of Barack Obama{END}
{USER}
How can I make charcoal?{END}
{BOT}
Charcoal,Charcoal Kiln,Retort (Chemistry){END}
{USER}
{SLOT}{END}
{BOT}
"""

CONTEXT_TEXT = f"""{SYS}
Directly answer the user's question.
Use only the following context information for the user's question:
{SLOT}{END}
{USER}
{SLOT}{END}
{BOT}
"""

ANSWER_TEXT = f"""{SYS}
Directly answer the user's question based on two other assistants' attempted answers.
Answer only based on the two assistants' answers. First assistant's answer:
{SLOT}

Second assistant's answer:
{SLOT}{END}
{USER}
{SLOT}{END}
{BOT}
"""

RETRIEVAL_TEXT = f"""{SYS}
Your task is to write JSONL questions and answers to evaluate a search system.
You will give five factual questions from the specified article with answers.
The questions should be obscure but easy to identify from the article text.
The answers should be a single short and unambiguous string (one to three words) that the search engine should include in its result.
The entire response should be formatted as JSONL without any additional commentary or markdown. Here is the format to use:

["question": "What month was Barack Obama born?", "answer": "august"]

If the article is unsuitable for essay questions, return only a newline.{END}
{USER}
article_id: 12
title: "Anarchy"
text: "Anarchy is a form of society without... (full text omitted from conversation history)"{END}
{BOT}
["question": "When did Donatien Alphonse François write Juliette?", "answer": "1797"]
["question": "What Greek word is 'anarchy' derived from?'", "answer": "αναρχία"]
["question": "Who wrote 'The Limits of State Action' about anarchy?", "answer": "Wilhelm von Humboldt"]
["question": "When was the International Workingmen's Association founded?", "answer": "1864"]
["question": "Which of Thomas Hobbes or John Locke disapproved of anarchy?", "answer": "Thomas Hobbes"]{END}
{USER}
article_id: {SLOT}
title: {SLOT}
text: {SLOT}{END}
{BOT}"""

ESSAY_TEXT = f"""{SYS}
{SLOT} {SLOT} {SLOT}
Give five JSON Lines of essay questions based on the article text.
The entire response should be formatted as JSONL without any additional commentary.
If the article is unsuitable for essay questions, return only a newline.{END}
{USER}
{{"article_id": "12", "text": "Anarchy is a form of society without... (full text omitted from conversation history)" }}{END}
{BOT}
{{"article_id": "12", "question": "Describe three major criticisms of Anarchy" }}
{{"article_id": "12", "question": "What are the origins of the word 'anarchy'?" }}
{{"article_id": "12", "question": "Why is anarchy considered a social disorder?" }}
{{"article_id": "12", "question": "Describe how John Calvin compared anarchy to tyranny and why." }}
{{"article_id": "12", "question": "What is the 'state of nature' according to John Locke?" }}{END}
{USER}
{{"article_id": {SLOT}, "title": {SLOT}, "text": {SLOT} }}{END}
{BOT}"""


@dataclass(frozen=True)
class RoleTokens:
    """Markers of who speaks."""

    system: str = "<|system|>"
    user: str = "<|user|>"
    assistant: str = "<|assistant|>"
    end: str = "<|end|>"

    def template(self, text: str) -> Template:
        for mark, token in ((SYS, self.system), (USER, self.user), (BOT, self.assistant), (END, self.end)):
            text = text.replace(mark, token)
        return tuple(text.split(SLOT))


DEFAULT_TOKENS = RoleTokens()


@dataclass(frozen=True)
class PromptSet:
    """The three templates of the answering chain: slots (question), (context, question) and
    (lexical answer, semantic answer, question)."""

    search: Template = DEFAULT_TOKENS.template(SEARCH_TEXT)
    context: Template = DEFAULT_TOKENS.template(CONTEXT_TEXT)
    answer: Template = DEFAULT_TOKENS.template(ANSWER_TEXT)

    @classmethod
    def of(cls, tokens: RoleTokens) -> PromptSet:
        return cls(*map(tokens.template, (SEARCH_TEXT, CONTEXT_TEXT, ANSWER_TEXT)))


# What a variant may override, under the names the evaluation uses, and its field in a PromptSet.
OVERRIDES = {"lexical": "search", "context": "context", "synthesis": "answer"}


@dataclass(frozen=True)
class PromptVariant:
    """A named override of one template; ``kind`` is lexical, context or synthesis."""

    name: str
    kind: str
    template: Template


def pieces(template: Template) -> Column:
    return F.array(*map(F.lit, template))


def render(template: Template | Column, *slots: Column) -> Column:
    """``template[0] || slot 0 || template[1] || ...``; a null slot renders as nothing."""
    def piece(i: int) -> Column:
        return template[i] if isinstance(template, Column) else F.lit(template[i])

    text = [piece(0)]
    for i, slot in enumerate(slots, 1):
        text += [F.coalesce(slot.cast("string"), F.lit("")), piece(i)]
    return F.concat(*text)


def chosen(prompts: PromptSet, kind: str, variants: list[PromptVariant] = (),
           variant: Column | None = None) -> Template | Column:
    """Template of a stage: the override a row's variant brings, else the default."""
    default = getattr(prompts, OVERRIDES[kind])
    mine = [v for v in variants if v.kind == kind]
    if not mine or variant is None:
        return default
    override = F.lit(None).cast("array<string>")
    for v in mine:
        override = F.when(variant == v.name, pieces(v.template)).otherwise(override)
    return F.coalesce(override, pieces(default))


def search_prompt(question: Column, tokens: RoleTokens = DEFAULT_TOKENS) -> Column:
    return render(tokens.template(SEARCH_TEXT), question)


def context_prompt(context: Column, question: Column, tokens: RoleTokens = DEFAULT_TOKENS) -> Column:
    return render(tokens.template(CONTEXT_TEXT), context, question)


def answer_prompt(lexical: Column, semantic: Column, question: Column,
                  tokens: RoleTokens = DEFAULT_TOKENS) -> Column:
    return render(tokens.template(ANSWER_TEXT), lexical, semantic, question)


def retrieval_prompt(article_id: Column, title: Column, text: Column,
                     tokens: RoleTokens = DEFAULT_TOKENS) -> Column:
    return render(tokens.template(RETRIEVAL_TEXT), article_id, title, text)


def essay_prompt(article_id: Column, title: Column, text: Column,
                 tokens: RoleTokens = DEFAULT_TOKENS) -> Column:
    return render(tokens.template(ESSAY_TEXT), article_id, title, text, article_id, title, text)


def chat_turn(role: Column, text: Column, tokens: RoleTokens = DEFAULT_TOKENS) -> Column:
    """One turn of a conversation: role token, text, end token, each on the usual line."""
    names = {"system": tokens.system, "user": tokens.user, "assistant": tokens.assistant}
    marks = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(marks, role), F.lit(tokens.user)), F.lit("\n"),
                    text, F.lit(tokens.end), F.lit("\n"))
