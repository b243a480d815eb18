"""Question sets: written by a caller's model over whole articles, or taken from the articles themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.generation import QUESTION_WRITING, Factory, Sampling, generate
from ..functions.json_lines import parse_object, parse_questions, has_question_shape, valid_questions
from ..functions.prompts import essay_prompt, retrieval_prompt
from ..functions.text import sentences, tokens, windows
from ..operators.lexical_index import LexicalIndex, posting_rows
from ..session import cut, fits_broadcast, parallel, pieces_of
from ..sources.articles import prefix_rows
from ..sources.tables import union_all, write_json_lines
from .reading import SCORE_DIGITS, rarity

# Pieces between blanks of an article that one prompt holds, and shares with the one before.
PROMPT_WORDS = 3000
PROMPT_OVERLAP = 100
# Postings that one task sorts by article.
TASK_POSTINGS = 1 << 20
GAP = "____"
ESSAY_TERMS = 3


def _write_questions(articles: DataFrame, n: int | None, prompt, factory, sampling: Sampling) -> DataFrame:
    rows = articles.select("article_id", "article_seq", "title", "text")
    rows = (rows if n is None else prefix_rows(rows, n)).select(
        "article_id", "title", F.posexplode(windows(F.coalesce("text", F.lit("")), PROMPT_WORDS, PROMPT_OVERLAP))
        .alias("window_no", "part"))
    rows = rows.select(F.col("article_id").cast("string").alias("source_article_id"), "window_no",
                       prompt(F.col("article_id"), F.col("title"), F.col("part")).alias("prompt"))
    return valid_questions(parse_questions(generate(rows, factory, sampling=sampling)))


def retrieval_questions(articles: DataFrame, factory: Factory, n: int | None = None,
                        sampling: Sampling = QUESTION_WRITING) -> DataFrame:
    """Factual questions with answers that a model writes about all articles, or the first ``n``:
    (source_article_id, window_no, line_no, article_id, question, answer, members). A long article
    has a prompt for each window."""
    return _write_questions(articles, n, retrieval_prompt, factory, sampling)


def essay_questions(articles: DataFrame, factory: Factory, n: int | None = None,
                    sampling: Sampling = QUESTION_WRITING) -> DataFrame:
    """Essay questions, same columns."""
    return _write_questions(articles, n, essay_prompt, factory, sampling)


def telling_terms(index: LexicalIndex, n: int, field: str = "text") -> DataFrame:
    """(article_id, terms): the ``n`` words of each article with the highest tf x idf, best first.

    Frequencies join the blocks, before postings become rows. Those are shuffled once, by article, into as
    many tasks as their counted number asks for; ties go to the smaller word.
    """
    from pyspark.sql.window import Window as W
    known = index.doc_freq.where(F.col("field") == field).select("term", "df")
    tasks = max(pieces_of(known.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"], TASK_POSTINGS),
                parallel(known.sparkSession))
    few = fits_broadcast(known, ["term", "df"])
    known = F.broadcast(known) if few else known.repartition(tasks, "term")

    def weighable(blocks: DataFrame) -> DataFrame:
        held = blocks.where(F.col("field") == field)
        return posting_rows((held if few else held.repartition(tasks, "term")).join(known, "term"), "df")

    rows = union_all([index.live(s, weighable(s.blocks)) for s in index.segments])
    weighed = (rows.withColumn("n", index.stats.where(F.col("field") == field).select("n").scalar())
               .select("article_id", "term", F.round(F.col("tf") * rarity(F.col("df"), F.col("n")), SCORE_DIGITS).alias("weight"))
               .repartition(tasks, "article_id"))
    order = W.partitionBy("article_id").orderBy(F.desc("weight"), "term")
    best = weighed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("nth", "term")))  # at most n
    return best.groupBy("article_id").agg(F.transform(ordered, lambda t: t["term"]).alias("terms"))


def cloze_questions(articles: DataFrame, index: LexicalIndex) -> DataFrame:
    """(article_id, question, answer): of each article the first sentence with its most telling word,
    which is left out and asked for."""
    cut_up = F.transform(sentences(F.col("text")), lambda s, no: F.struct(no.alias("no"), tokens(s).alias("words")))
    held = F.get(F.filter(cut_up, lambda s: F.array_contains(s["words"], F.col("answer"))), F.lit(0))
    spans = (articles.join(telling_terms(index, 1), "article_id")
             .withColumn("answer", F.get("terms", F.lit(0))).withColumn("span", held).where("span is not null"))
    first = spans.groupBy("article_id").agg(F.min(F.struct("span.no", "span.words", "answer")).alias("s"))
    gapped = F.transform("s.words", lambda w: F.when(w == F.col("s.answer"), GAP).otherwise(w))
    return first.select("article_id", F.array_join(gapped, " ").alias("question"), F.col("s.answer").alias("answer"))


def topic_questions(articles: DataFrame, index: LexicalIndex, n: int = ESSAY_TERMS) -> DataFrame:
    """(article_id, question): an essay question about the ``n`` most telling words of each article."""
    topics = telling_terms(index, n)
    return articles.select("article_id", "title").join(topics, "article_id").select(
        "article_id", F.concat(F.lit("How do "), F.array_join("terms", ", "), F.lit(" belong together in "),
                               F.coalesce("title", F.lit("")), F.lit("?")).alias("question"))


def write_questions(questions: DataFrame, path: str) -> DataFrame:
    """Write the members of each question as JSON lines; returns what was written.

    The questions are generated once, for both uses.
    """
    once = cut(questions)
    write_json_lines(once, "members", path)
    return once


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, question, answer) of JSON lines; lines without question shape drop out."""
    lines = spark.read.text(path).withColumn("members", parse_object(F.col("value")))
    return valid_questions(lines.withColumn("ok", has_question_shape(F.col("members")))).select(
        "article_id", "question", "answer")
