"""Text expressions: analysis, titles, prefix cuts, paragraph ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates terms, how paragraphs are separated, how long a text may be
# inside a context and inside a question-writing prompt.
TERM_SEPARATOR = r"[^\p{L}\p{N}]+"
PARAGRAPH_DELIMITER = "\n\n"
SENTENCE_END = r"[.!?\n]+"
CONTEXT_CHARS = 12000
ARTICLE_CHARS = 14000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), TERM_SEPARATOR), F.lit(""))


def pieces(text: Column, delimiter: str = PARAGRAPH_DELIMITER) -> Column:
    """Every piece between delimiters; empty and trailing pieces are kept."""
    return F.split(text, f"\\Q{delimiter}\\E")


def sentences(text: Column) -> Column:
    """Pieces between sentence ends, also empty ones."""
    return F.split(text, SENTENCE_END)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of ``size`` pieces between blanks, which together hold the whole text.

    Each window but the first begins with the last ``overlap`` pieces of the one before.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    words = F.split(text, " ")
    count = F.greatest(F.ceil((F.size(words) - overlap) / (size - overlap)), F.lit(1))
    starts = F.sequence(F.lit(0), (count - 1).cast("int"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i * (size - overlap) + 1, size), " "))


def first_line(text: Column) -> Column:
    """Title of an article that has none: its first line."""
    return F.split_part(text, F.lit("\n"), F.lit(1))


def prefix(text: Column, chars: int) -> Column:
    """The first ``chars`` code points."""
    return F.substring(text, 1, chars)


def paragraph_id(article_id: Column, paragraph_no: Column) -> Column:
    return F.concat(article_id.cast("string"), F.lit("."), paragraph_no.cast("string"))


def article_part(paragraph_id: Column) -> Column:
    return F.split_part(paragraph_id, F.lit("."), F.lit(1))


def number_part(paragraph_id: Column) -> Column:
    """0-based paragraph number; null when the id carries none."""
    return F.split_part(paragraph_id, F.lit("."), F.lit(2)).try_cast("int")
