"""Question lines written by a model: repair, strict parsing, shape check, counts."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is stripped from both ends of an output, and (with commas) of a line.
OUTPUT_ENDS = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+\z"
LINE_ENDS = r"^[ \t\n\r\f\x0B,]+|[ \t\n\r\f\x0B,]+\z"

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def repair_line(line: Column) -> Column:
    """Strip blanks and commas; an opening ``[`` becomes ``{``, a closing ``]`` becomes ``}``."""
    bare = F.regexp_replace(line, LINE_ENDS, "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\[", "{"), r"\]\z", "}")


def split_output(outputs: DataFrame, column: str = "output") -> DataFrame:
    """One row per line of each model output, with its ordinal, repaired."""
    keep = [c for c in outputs.columns if c != column]
    stripped = F.regexp_replace(F.col(column), OUTPUT_ENDS, "")
    return (outputs.select(*keep, F.posexplode(F.split(stripped, "\n")).alias("line_no", "raw_line"))
            .select(*keep, "line_no", repair_line(F.col("raw_line")).alias("line")))


def parse_object(line: Column) -> Column:
    """Members of a line that is exactly one JSON object, as text; null for any other line.

    The lenient parser would take an object with text after it. So the line is parsed as a
    member of a wrapper that ends in a mark of its own, which trailing text breaks; the mark
    is random, which keeps a line from closing the wrapper itself.
    """
    mark = f"_end_{secrets.token_hex(8)}"
    wrapped = F.from_json(F.concat(F.lit('{"w":'), line, F.lit(f',"{mark}":1}}')), "map<string,string>", _STRICT)
    whole = line.startswith("{") & (F.map_keys(wrapped) == F.array(F.lit("w"), F.lit(mark)))
    return F.when(whole, _last_of_equal(F.from_json(wrapped["w"], "map<string,string>", _STRICT)))


def _last_of_equal(members: Column) -> Column:
    """Of members with one name the last counts."""
    names = F.map_keys(members)
    last = F.filter(F.map_entries(members), lambda entry, i: F.array_position(
        F.slice(names, i + 2, F.size(names)), entry["key"]) == 0)
    return F.when(F.size(F.array_distinct(names)) == F.size(names), members).otherwise(F.map_from_entries(last))


def has_question_shape(members: Column) -> Column:
    """A question together with an article id or an answer."""
    def there(name: str) -> Column:
        return F.map_contains_key(members, name)
    return F.coalesce(there("question") & (there("article_id") | there("answer")), F.lit(False))


def parse_questions(outputs: DataFrame, column: str = "output") -> DataFrame:
    """Every line of every output with ``members MAP<STRING,STRING>`` and ``ok``."""
    lines = split_output(outputs, column).withColumn("members", parse_object(F.col("line")))
    return lines.withColumn("ok", has_question_shape(F.col("members")))


def valid_questions(parsed: DataFrame) -> DataFrame:
    """Typed columns of the lines that passed; other members stay in ``members``."""
    def member(name: str) -> Column:
        return F.try_element_at("members", F.lit(name)).alias(name)
    rest = [c for c in parsed.columns if c not in ("line", "members", "ok", "article_id")]
    return parsed.where("ok").select(*rest, member("article_id"), member("question"), member("answer"), "members")


def parse_quality(parsed: DataFrame) -> DataFrame:
    """(total, valid, errors)."""
    return parsed.agg(F.count("*").alias("total"), F.count_if("ok").alias("valid"),
                      F.count_if(~F.col("ok")).alias("errors"))
