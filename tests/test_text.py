"""Paragraphs, ids, lookups, prefix cuts, positions, shards."""

import pytest
from pyspark.sql import functions as F

from ragspark.functions import text
from ragspark.operators import paragraphs
from ragspark.sources import articles as corpus


def _articles(spark, *texts):
    rows = [(str(i + 12), i, f"title {i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "article_id STRING, article_seq BIGINT, title STRING, text STRING")


@pytest.mark.parametrize("body,expected", [
    ("a\n\nb", ["a", "b"]), ("", [""]), ("a\n\n", ["a", ""]), ("a\n\n\nb", ["a", "\nb"]), ("a\nb", ["a\nb"]),
])
def test_split_keeps_every_piece(spark, body, expected):
    rows = paragraphs.split_paragraphs(_articles(spark, body)).orderBy("paragraph_no").collect()
    assert [r.paragraph for r in rows] == expected
    assert [r.paragraph_id for r in rows] == [f"12.{i}" for i in range(len(expected))]


def test_delimiter_is_taken_literally(spark):
    rows = paragraphs.split_paragraphs(_articles(spark, "a.b.c"), ".").collect()
    assert [r.paragraph for r in rows] == ["a", "b", "c"]


def test_ids_and_lookups(spark):
    articles = _articles(spark, "a\n\nb", "c")
    ids = spark.createDataFrame([("12.0",), ("12.1",), ("12.2",), ("99.0",), ("12",)], "paragraph_id STRING")
    parsed = {r.paragraph_id: (r.article_id, r.paragraph_no) for r in paragraphs.parse_ids(ids).collect()}
    assert parsed["12.1"] == ("12", 1) and parsed["12"] == ("12", None)
    found = {r.paragraph_id: r.paragraph for r in paragraphs.paragraph_to_text(ids, articles).collect()}
    assert found == {"12.0": "a", "12.1": "b", "12.2": None, "99.0": None, "12": None}
    whole = {r.paragraph_id: r.title for r in paragraphs.paragraph_to_article(ids, articles).collect()}
    assert whole == {"12.0": "title 0", "12.1": "title 0", "12.2": "title 0", "12": "title 0"}
    asked = spark.createDataFrame([("13",), ("77",)], "article_id STRING")
    assert {r.article_id: r.found for r in paragraphs.get_by_id(asked, articles).collect()} == {"13": True, "77": False}


@pytest.mark.parametrize("limit", [text.CONTEXT_CHARS, text.ARTICLE_CHARS])
def test_prefix_counts_code_points(spark, limit):
    bodies = ["x" * (limit - 1), "x" * limit, "x" * (limit + 1), "😀" * (limit + 1)]
    df = spark.createDataFrame([(b,) for b in bodies], "text STRING")
    got = [r[0] for r in df.select(text.prefix(F.col("text"), limit)).collect()]
    assert got == [b[:limit] for b in bodies]


def test_tokens(spark):
    df = spark.createDataFrame([("Ünïted-States, 42!  a_b",), ("",), (None,)], "t STRING")
    got = [r[0] for r in df.select(text.tokens(F.col("t"))).collect()]
    assert got == [["ünïted", "states", "42", "a", "b"], [], None]


def test_positions_follow_the_scan(spark, tmp_path):
    spark.range(0, 10_000, 1, 7).write.parquet(str(tmp_path / "t"))
    scanned = spark.read.parquet(str(tmp_path / "t"))
    placed = corpus.with_positions(scanned)
    assert sorted(r.article_seq for r in placed.collect()) == list(range(10_000))
    first = scanned.withColumn("m", F.monotonically_increasing_id()).orderBy("m").limit(50).collect()
    assert [r.id for r in placed.orderBy("article_seq").limit(50).collect()] == [r.id for r in first]


def test_slices_and_shards(spark):
    rows = _articles(spark, *["x"] * 10)
    assert [r.article_seq for r in corpus.prefix_rows(rows, 3).collect()] == [0, 1, 2]
    assert corpus.prefix_percent(rows, 25).count() == 3  # 2.5 rounds up
    assert [r.article_seq for r in corpus.range_rows(rows, 4, 6).orderBy("article_seq").collect()] == [4, 5]
    counts = [r["count"] for r in corpus.assign_shards(rows, shards=4).groupBy("shard").count().orderBy("shard").collect()]
    assert counts == [3, 3, 3, 1]  # the last shard is short
    assert {r.shard for r in corpus.assign_shards(rows, shard_rows=226_562).collect()} == {0}
