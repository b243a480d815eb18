"""Answering an unbounded input of questions.

Each micro-batch is written to its own ``batch_id`` partition; a batch that is replayed after a stop
overwrites that partition, so nothing is answered twice. ``answer_stream`` runs a search or a whole
chain over every batch. ``remembering_stream`` also keeps what it found: a question that was asked
before is answered from a table of known answers, keyed by the question, for as long as the index
version it was answered with is in force and its entry is not older than ``keep_batches``. Between
batches a new index version comes into force by itself; answers found with an older one expire.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import cut, sized
from ..sources.tables import finished_folders, folders

#: Batches for which an answer is remembered.
KEEP_BATCHES = 1000


def question_stream(spark: SparkSession, path: str, schema: str, glob: str = "*.parquet",
                    files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder as they arrive. ``path`` may also name one table, a file or a
    folder of files."""
    head, _, name = path.rstrip("/").rpartition("/")
    # as a pattern with one match a path may be a file; files in folders below it count too
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_batch).parquet(f"{head}/{{{name}}}"))


def _started(questions: DataFrame, one_batch, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (questions.writeStream.foreachBatch(one_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    (rows.withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str,
                  checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start ``answer`` (a retriever, or the whole chain) over ``questions(qid, question)``.

    ``trigger`` defaults to draining what is there. Pass ``{"processingTime": "10 seconds"}``
    to keep running.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # the batch is read by several stages of a search
        held = batch.persist()
        try:
            _write_batch(answer(held), path, batch_id)
        finally:
            held.unpersist()

    return _started(questions, one_batch, checkpoint, trigger)


def known_answers(spark: SparkSession, state: str, version: str, before: int, keep_batches: int) -> DataFrame | None:
    """(key, question, found) of the answers still in force for batch ``before``: of the batches before
    it, found with this index version, the newest of each question. None where there is none."""
    # every entry lies in a folder of its own that is finished or absent
    batches = sorted(int(name.split("=")[1]) for name in finished_folders(spark, state) if name.startswith("batch="))
    mine = [b for b in batches if before - keep_batches <= b < before]
    if not mine:
        return None
    rows = spark.read.parquet(*(f"{state}/batch={b}" for b in mine)).where(F.col("version") == version)
    newest = F.max_by(F.struct("question", "found"), F.col("batch_id")).alias("row")
    return rows.groupBy("key", "question").agg(newest).select("key", "row.question", "row.found")


def remembering_stream(questions: DataFrame, current: Callable[[], tuple[str, Callable[[DataFrame], DataFrame]]],
                       path: str, state: str, checkpoint: str, keep_batches: int = KEEP_BATCHES,
                       trigger: dict | None = None) -> StreamingQuery:
    """Like ``answer_stream``, with a table of known answers under ``state``.

    ``current`` is called for each batch and returns the index version in force with a retriever over it,
    which maps ``qid, question`` to rows with ``qid`` and whatever an answer consists of. Equal
    questions, and those that only state knows, are not searched again. A question without hits is known
    too. Batch ``n`` reads state of batches before ``n`` only, so a replay gives the same rows.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asked = cut(batch.select("qid", "question").withColumn("key", F.xxhash64("question")))
        version, retrieve = current()
        distinct = asked.where("question IS NOT NULL").select("key", "question").distinct()
        known = known_answers(spark, state, version, batch_id, keep_batches)
        new = distinct
        if known is not None:
            known = cut(known.join(sized(distinct, ["key", "question"]), ["key", "question"], "left_semi"))
            new = distinct.join(sized(known.select("key", "question"), ["key", "question"]), ["key", "question"], "left_anti")
        # a number names the row that is searched: a search holds it next to each term
        new = cut(new.withColumn("number", F.monotonically_increasing_id()))
        found = retrieve(new.select(F.col("number").alias("qid"), "question")).withColumnRenamed("qid", "number")
        columns = [c for c in found.columns if c != "number"]
        hits = found.groupBy("number").agg(F.collect_list(F.struct(*columns)).alias("found"))  # at most k
        empty = F.array().cast(hits.schema["found"].dataType)
        told = new.join(hits, "number", "left").select("key", "question", F.coalesce("found", empty).alias("found"))
        entry = f"{state}/batch={batch_id}"
        (told.select("key", "question", "found", F.lit(version).alias("version"), F.lit(batch_id).alias("batch_id"))
         .write.mode("overwrite").parquet(entry))
        fresh = spark.read.parquet(entry).select("key", "question", "found")
        answers = fresh if known is None else fresh.unionByName(known)
        rows = asked.join(sized(answers, ["key", "question", "found"]), ["key", "question"]).select("qid", F.inline("found"))
        _write_batch(rows, path, batch_id)

    return _started(questions, one_batch, checkpoint, trigger)


def read_answers(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """What was answered so far. With ``schema`` an empty table where no question had an answer."""
    if schema is not None and not any(name.startswith("batch_id=") for name in folders(spark, path)):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).drop("batch_id")
