"""Sinks: restarts, upserts, snapshots, guarded reads."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ragspark.operators import quantize
from ragspark.plans import embedding_job
from ragspark.sources import articles, tables
from ragspark.sources.articles import ARTICLE_SCHEMA, assign_shards, read_articles


def _rows(spark, n=40):
    return spark.range(n).select(F.col("id").alias("article_id"), F.col("id").alias("article_seq"),
                                 F.concat(F.lit("t"), "id").alias("text"))


def test_missing_table_is_named(spark, tmp_path):
    with pytest.raises(tables.MissingTableError, match="nowhere"):
        tables.read_table(spark, str(tmp_path / "nowhere"))
    _rows(spark).write.parquet(str(tmp_path / "cache"))
    assert tables.first_table(spark, str(tmp_path / "nowhere"), str(tmp_path / "cache")).count() == 40


def test_read_articles(spark, tmp_path):
    spark.createDataFrame([("1", "u", "t", "x")], ARTICLE_SCHEMA).write.parquet(str(tmp_path / "a"))
    assert read_articles(spark, str(tmp_path / "a")).first().asDict() == {
        "article_id": "1", "url": "u", "title": "t", "text": "x"}


def test_bounded_files_and_create_only(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(_rows(spark, 1000).coalesce(1), path, rows_per_file=300)
    sizes = [pq.read_metadata(f).num_rows for f in glob.glob(path + "/*.parquet")]
    assert sum(sizes) == 1000 and max(sizes) <= 300
    tables.write_table(_rows(spark, 5), path, mode="ignore")
    assert spark.read.parquet(path).count() == 1000


def test_sharded_write_restarts_where_it_stopped(spark, tmp_path):
    path, calls = str(tmp_path / "s"), []
    rows = assign_shards(_rows(spark), shard_rows=6)     # 7 shards, the last one short

    def failing(df):
        calls.append(sorted(r.shard for r in df.select("shard").distinct().collect()))
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return df.select("shard", "article_id")

    with pytest.raises(RuntimeError, match="stopped"):
        tables.write_shards(rows, path, failing, shard_rows=6, shards_per_job=2)
    assert calls == [[0, 1], [2, 3]]
    # a half-written shard without a commit entry is not taken for done
    spark.createDataFrame([(2, 999)], "shard INT, article_id BIGINT").write.partitionBy("shard").mode("append").parquet(
        path + "/data")
    assert tables.read_shards(spark, path).count() == 12
    assert tables.write_shards(rows, path, failing, shard_rows=6, shards_per_job=2) == [2, 3, 4, 5, 6]
    assert sorted(r.article_id for r in tables.read_shards(spark, path).collect()) == list(range(40))
    assert tables.write_shards(rows, path, failing, shard_rows=6) == []


def test_upsert_keeps_the_highest_version(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "id INT, v STRING")
    new = spark.createDataFrame([(2, "new1", 1), (2, "new3", 3), (2, "new2", 2), (9, "new", 1)],
                                "id INT, v STRING, version INT")
    assert {r.id: r.v for r in tables.upsert(old, new, "id").collect()} == {1: "old", 2: "new3", 3: "old", 9: "new"}
    plain = new.where("id = 9").drop("version")
    assert tables.upsert(old, plain, "id").count() == 4


def test_snapshot_round_trip(spark, tmp_path):
    root = str(tmp_path / "snap")
    parts = {"a": _rows(spark), "b": spark.createDataFrame([(1, None), (2, "x")], "k INT, v STRING")}
    made = {r.table_name: (r.rows, r.checksum) for r in tables.create_snapshot(parts, root, "one").collect()}
    assert made["a"][0] == 40 and made["b"][0] == 2
    tables.create_snapshot({"a": _rows(spark, 3)}, root, "two")
    assert {(r.snapshot, r.table_name) for r in tables.list_snapshots(spark, root).collect()} == {
        ("one", "a"), ("one", "b"), ("two", "a")}
    assert sorted(tables.restore_snapshot(spark, root, "one")["a"].collect()) == sorted(_rows(spark).collect())
    _rows(spark, 1).write.mode("append").parquet(root + "/snapshot=one/a")
    with pytest.raises(RuntimeError, match="differs"):
        tables.restore_snapshot(spark, root, "one")
    with pytest.raises(tables.MissingTableError):
        tables.restore_snapshot(spark, root, "three")


def test_vector_index_is_left_alone(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "id INT, embedding ARRAY<FLOAT>")
    path = str(tmp_path / "v")
    index, ranges = quantize.save_vector_index(vectors, path)
    assert {r.id: (r.qv, round(r.norm, 3)) for r in index.collect()} == {
        1: ([-128, 127], 180.314), 2: ([127, -128], 180.314)}
    quantize.save_vector_index(vectors.limit(1), path)
    assert spark.read.parquet(path + "/vectors").count() == 2 and ranges.count() == 2


def test_batches_follow_the_counted_bytes(spark, tmp_path):
    rows = spark.range(2000).select("id", F.expr("repeat('x', 500)").alias("text"))
    assert tables.write_sized(rows, str(tmp_path / "a"), 200_000) == 6
    files = glob.glob(str(tmp_path / "a" / "*.parquet"))
    assert len(files) == 6 and spark.read.parquet(str(tmp_path / "a")).count() == 2000
    assert tables.write_sized(rows.limit(0), str(tmp_path / "b")) == 1


def test_positions_follow_the_keys(spark):
    ids = [f"k{i:03d}" for i in range(500)]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "article_id STRING").repartition(7)
    got = {r.article_id: r.article_seq for r in articles.positions_by_key(df).collect()}
    assert got == {k: n for n, k in enumerate(ids)}
    assert articles.positions_by_key(df.limit(0)).count() == 0


def test_embedding_job_goes_on_where_it_stopped(spark, tmp_path):
    path, log = str(tmp_path / "job"), str(tmp_path / "log")
    df = spark.createDataFrame([(f"a{i:02d}", f"one {i}\n\ntwo {i}") for i in range(40)], "article_id STRING, text STRING")

    def encoder(broken):
        def made():
            def encode(texts):
                values = texts.to_pylist()
                if broken and any(v.endswith(" 25") for v in values):
                    raise RuntimeError("stopped")
                with open(log, "a") as f:
                    f.writelines(v + "\n" for v in values)
                return np.array([[float(v.split()[1]), 1.0] for v in values], np.float32)
            return encode
        return made
    with pytest.raises(Exception, match="stopped"):
        embedding_job.process_embeddings(df, path, encoder(True), 2, shards=10, shards_per_job=2)
    done = {r.shard for r in tables.committed_shards(spark, path).collect()}
    assert done == {0, 1, 2, 3, 4, 5}       # article 25 is in shard 6
    open(log, "w").close()
    made = embedding_job.process_embeddings(df.limit(0), path, encoder(False), 2, shards=10, shards_per_job=2)
    rows = {r.id: (r.shard, list(r.embedding)) for r in made.collect()}
    assert len(rows) == 80 and rows["a25.1"] == (6, [25.0, 1.0])
    again = {int(line.split()[1]) for line in open(log)}
    assert again == set(range(24, 40))      # only shards without a record
