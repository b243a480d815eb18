"""Repair and strict parsing of question lines."""

import json

import pytest

from ragspark.functions import json_lines
from ragspark.plans.question_sets import read_questions, write_questions

KEPT = [
    '["question": "a?", "answer": "x"]',
    ' ,{"article_id": 12, "question": "q"},',
    '{"question": "w", "answer": "x", "extra": 1}',
    '{"question": null, "answer": "b"}',
    '{"question": 5, "answer": ["a","b"]}',
    '{"question": "αναρχία", "answer": "}{"}',
]
DROPPED = [
    "{'question': 'a', 'answer': 'b'}",
    '{"question": "a", "answer": "b"} trailing',
    '{"question": "a", "answer": "b"}}',
    '{"question": "a", "answer": "b"}, {"question": "c", "answer": "d"}',
    '{"question": "a", "answer": "b",}',
    '{"Question": "a", "answer": "b"}',
    '{"question": "a"}',
    "[]", "", "hello", "5", "null", "true", '"question answer"',
    '"{\\"question\\":\\"a\\",\\"answer\\":\\"b\\"}"',
    '{"question": NaN, "answer": "b"}',
    '{"question": "a", "answer": "b"},"_end":1} junk',
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, line) for i, line in enumerate(KEPT + DROPPED)]
    df = json_lines.parse_questions(spark.createDataFrame(rows, "i INT, output STRING"))
    return {r.i: r for r in df.collect()}


def test_kept_and_dropped(parsed):
    assert [i for i, r in sorted(parsed.items()) if r.ok] == list(range(len(KEPT)))


def test_values(parsed):
    assert parsed[1].members == {"article_id": "12", "question": "q"}
    assert parsed[2].members["extra"] == "1"
    assert parsed[3].members["question"] is None
    assert json.loads(parsed[4].members["answer"]) == ["a", "b"]


def test_last_of_equal_members_wins(spark):
    df = spark.createDataFrame([('{"question":"a","question":"z","answer":"b"}',)], "output STRING")
    assert json_lines.valid_questions(json_lines.parse_questions(df)).first().question == "z"


def test_lines_ordinals_and_counts(spark):
    output = '\n\nSure!\n {"question":"q","answer":"a"} ,\n\n["question":"r","answer":"b"]\n\f'
    parsed = json_lines.parse_questions(spark.createDataFrame([(output,)], "output STRING"))
    assert [(r.line_no, r.ok) for r in parsed.orderBy("line_no").collect()] == [
        (0, False), (1, True), (2, False), (3, True)]
    assert json_lines.parse_quality(parsed).first().asDict() == {"total": 4, "valid": 2, "errors": 2}


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(line,) for line in KEPT], "output STRING")
    path = str(tmp_path / "q")
    write_questions(json_lines.valid_questions(json_lines.parse_questions(df)), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) == len(KEPT) and any("αναρχία" in line for line in lines)
    assert all(isinstance(json.loads(line), dict) for line in lines)
    assert {"question": None, "answer": "b"} in [json.loads(line) for line in lines]
    assert read_questions(spark, path).count() == len(KEPT)
