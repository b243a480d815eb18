"""Stored approximate index: inverted lists of int8 vectors around coarse centroids.

Centroids come from a bounded sample (the smallest md5 of the ids), either as they are or after some
rounds of spherical k-means; every vector is then filed under its ``spill`` nearest centroids. The
lists are folders of one table, rebalanced so that a list that holds a large share of all vectors
becomes many files of bounded size. The table of centroids with the lists' counted sizes is written
last and says that the index is whole.

A search ranks the lists for each query and probes the nearest ones, and further ones until they
hold enough vectors for ``k`` different hits, so none comes up short. Candidates are scored exactly. Few
queries (counted) travel to the lists, which are read where they lie, and only the probed ones;
many are dealt out with the lists.

The lists also serve an exact search: a list stores the widest angle between its centroid and the
vectors nearest to it. After a first round the k-th best score of a query is known, and by the triangle
inequality of angles a list can be left alone when even its closest vector could not reach it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT_BYTES, cut, pieces_of
from ..sources.tables import read_table, table_exists, union_all, write_table
from .knn import (CELL_ROWS, GROUP_QUERIES, PARAGRAPHS_PER_QUESTION, SCORE_DIGITS, _block_best, _cells, _final, _matrix, _norms,
                  _types)
from .topk import best_rows, whole

# Bounds of the index: lists, and sampled vectors a list when the centroids are trained.
LEAST_LISTS, MOST_LISTS = 4, 4096
SAMPLE_PER_LIST = 32
ROUNDS = 10
SPILL = 2
#: Share of the lists probed unless a number is given. Vectors without clusters need this many.
PROBED = 0.45


@dataclass(frozen=True)
class InvertedLists:
    """``lists`` holds ``list, nth, id, qv`` (``nth`` 0 for the nearest centroid); ``centroids``, ``sizes``
    and ``widths``, the widest angle of a vector filed under its nearest centroid, go by list number."""

    lists: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    widths: np.ndarray
    spill: int


def _cosines(rows: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    length = norms[:, None] * _norms(centroids)[None, :]
    dots = rows.astype(np.float64) @ centroids.T
    return np.rint(np.divide(dots, length, out=np.zeros_like(dots), where=length > 0) * 10.0 ** SCORE_DIGITS)


def _ranked(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest lists of each row; of equal ones the smaller number first."""
    return np.argsort(-_cosines(rows, _norms(rows), centroids), axis=1, kind="stable")[:, :n]


def train(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Centroids of a sample (rows in hash order): its first rows, moved by ``rounds`` of k-means."""
    centroids = sample[:lists].astype(np.float64)
    norms = _norms(sample)
    unit = np.divide(sample, norms[:, None], out=np.zeros(sample.shape), where=norms[:, None] > 0)
    for _ in range(rounds):
        nearest = np.argmax(_cosines(sample, norms, centroids), axis=1)
        for j in range(len(centroids)):
            mine = unit[nearest == j]
            if len(mine):
                centroids[j] = mine.mean(axis=0)
    return centroids


def _sampled(vectors: DataFrame, n: int) -> np.ndarray:
    """The vectors with the smallest md5 of their ids; ``n`` is bounded by the constants above."""
    rows = vectors.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n).select("qv").toArrow()
    return _matrix(rows.column("qv")).astype(np.float64) if rows.num_rows else np.zeros((0, 0))


def file_vectors(vectors: DataFrame, centroids: np.ndarray, spill: int = SPILL) -> DataFrame:
    """(list, nth, id, qv): every vector under its ``spill`` nearest centroids."""
    spill = min(spill, len(centroids))
    kind = vectors.schema["id"].dataType.simpleString()
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_LISTS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _ranked(_matrix(batch.column("qv")), sent.value, spill)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.ravel(), pa.int32()), pa.array(np.tile(np.arange(near.shape[1]), len(near)), pa.int32()),
                     batch.column("id").take(rows), batch.column("qv").take(rows)],
                    ["list", "nth", "id", "qv"])

    return vectors.select("id", "qv").mapInArrow(run, f"list int, nth int, id {kind}, qv array<tinyint>")


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines / 10.0 ** SCORE_DIGITS, -1, 1))


def _widths(lists: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(list, width): one row per task and list, then their maximum."""
    sent = lists.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest = np.full(len(sent.value), -1.0)
        for batch in batches:
            if batch.num_rows:
                rows, number = _matrix(batch.column(1)), batch.column(0).to_numpy()
                for one in np.unique(number).tolist():
                    mine = rows[number == one]
                    widest[one] = max(widest[one], _angles(_cosines(mine, _norms(mine), sent.value[one:one + 1])).max())
        held = np.flatnonzero(widest >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(widest[held])], ["list", "width"])

    return (lists.where("nth = 0").select("list", "qv").mapInArrow(run, "list int, width double")
            .groupBy("list").agg(F.max("width").alias("width")))


def save_lists(vectors: DataFrame, path: str, lists: int | None = None, rounds: int = ROUNDS, spill: int = SPILL,
               mode: str = "ignore") -> InvertedLists:
    """Write the index of ``vectors(id, qv)``. ``lists`` follows the square root of the counted rows
    unless given. ``rounds=0`` takes sampled vectors as centroids."""
    spark = vectors.sparkSession
    if mode == "ignore" and table_exists(spark, f"{path}/centroids"):
        return load_lists(spark, path)
    wanted = lists or min(max(int(np.ceil(np.sqrt(vectors.count()))), LEAST_LISTS), MOST_LISTS)
    sample = _sampled(vectors, wanted * (SAMPLE_PER_LIST if rounds else 1))
    centroids = train(sample, wanted, rounds) if len(sample) else np.zeros((1, 1))
    filed = file_vectors(vectors, centroids, spill)
    write_table(filed.hint("rebalance", "list"), f"{path}/lists", partition_by=["list"])
    kind = vectors.schema["id"].dataType.simpleString()
    stored = spark.read.schema(f"nth int, id {kind}, qv array<tinyint>, list int").parquet(f"{path}/lists")
    widths = {r["list"]: r["width"] for r in _widths(stored, centroids).collect()}  # one row a list
    counts = {r["list"]: r["n"] for r in stored.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    table = spark.createDataFrame([(i, c, counts.get(i, 0), widths.get(i, 0.0), min(spill, len(centroids)), kind)
                                   for i, c in enumerate(centroids.tolist())],
                                  "list int, centroid array<double>, size long, width double, spill int, id_type string")
    write_table(table.coalesce(1), f"{path}/centroids")
    return load_lists(spark, path)


def load_lists(spark: SparkSession, path: str) -> InvertedLists:
    rows = read_table(spark, f"{path}/centroids").orderBy("list").collect()  # at most MOST_LISTS
    schema = f"nth int, id {rows[0]['id_type']}, qv array<tinyint>, list int"
    return InvertedLists(spark.read.schema(schema).parquet(f"{path}/lists"), np.array([r["centroid"] for r in rows]),
                         np.array([r["size"] for r in rows], np.int64), np.array([r["width"] for r in rows]), rows[0]["spill"])


def _probes(queries: np.ndarray, index: InvertedLists, k: int, probes: int) -> list[np.ndarray]:
    """Lists of each query: the ``probes`` nearest, and more until they hold ``k`` different vectors."""
    order = _ranked(queries, index.centroids, len(index.centroids))
    held = np.cumsum(index.sizes[order], axis=1)
    before = np.concatenate([np.zeros((len(order), 1), np.int64), held[:, :-1]], axis=1)
    take = (np.arange(order.shape[1]) < probes) | (before < k * index.spill)
    return [o[t] for o, t in zip(order, take)]


def search_lists(queries: DataFrame, index: InvertedLists, k: int = PARAGRAPHS_PER_QUESTION, probes: int | None = None,
                 broadcast_limit: int = BROADCAST_LIMIT_BYTES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(qid, id, score, rank): the ``k`` nearest vectors among the probed lists of each query."""
    probes = probes or int(np.ceil(PROBED * len(index.centroids)))
    size = queries.agg(F.sum(F.size("qv") * 8 + 64 + 8 * probes).alias("bytes")).first()["bytes"] or 0
    if size <= broadcast_limit:
        asked = _Carried(queries)
        found = asked.search(index, _probes(asked.rows, index, k, probes), k) if len(asked.rows) else asked.nothing(index)
    else:
        found = _dealt_with_lists(queries, index, k, probes, cell_rows)
    # a vector of several probed lists has the same score in each
    return _final(found.groupBy("qid", "id").agg(F.max("score").alias("score")), k)


class _Carried:
    """Queries (counted, bounded) that travel to the lists."""

    def __init__(self, queries: DataFrame):
        table = queries.select("qid", "qv").toArrow()
        self.spark, self.qid_type = queries.sparkSession, queries.schema["qid"].dataType.simpleString()
        self.ids = whole(table.column("qid"))
        self.rows = _matrix(table.column("qv")) if table.num_rows else np.zeros((0, 0), np.float32)
        self.norms = _norms(self.rows)

    def _schema(self, index: InvertedLists) -> str:
        return f"qid {self.qid_type}, id {index.lists.schema['id'].dataType.simpleString()}, score double"

    def nothing(self, index: InvertedLists) -> DataFrame:
        return self.spark.createDataFrame([], self._schema(index))

    def search(self, index: InvertedLists, near: list[np.ndarray], k: int) -> DataFrame:
        """(qid, id, score): the best of each task in the lists ``near`` each query. What a task holds
        follows a group of the queries, not all of them."""
        return union_all([self._group(index, near[at:at + GROUP_QUERIES], k, at) for at in range(0, len(near), GROUP_QUERIES)])

    def _group(self, index: InvertedLists, near: list[np.ndarray], k: int, at: int) -> DataFrame:
        mine = slice(at, at + len(near))
        asked = np.repeat(np.arange(len(near)), [len(x) for x in near])
        lists = np.concatenate(near)
        order = np.argsort(lists, kind="stable")
        begin = np.searchsorted(lists[order], np.arange(len(index.centroids) + 1))
        sent = self.spark.sparkContext.broadcast((self.ids.take(pa.array(np.arange(at, at + len(near)))), self.rows[mine], self.norms[mine], asked[order], begin))
        keep = k * index.spill  # a hit may come once from each of its lists

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, rows, norms, asked, begin = sent.value
            best = None
            for batch in batches:
                number = batch.column(0).to_numpy()
                matrix = _matrix(batch.column(2)) if len(number) else None
                for one in np.unique(number).tolist():
                    here, who = np.flatnonzero(number == one), asked[begin[one]:begin[one + 1]]
                    if not len(who):
                        continue
                    new = _block_best(rows[who], norms[who], matrix[here], batch.column(1).take(pa.array(here)), k)
                    new = new.set_column(0, "q", pa.array(who[new.column("q").to_numpy()], pa.int64()))
                    best = new if best is None else pa.concat_tables([best, new])
                    if best.num_rows > 4 * keep * len(names) + 100_000:
                        best = best_rows(best, keep)
            if best is not None:
                best = best_rows(best, keep)
                out = pa.table({"qid": names.take(whole(best.column("q"))), "id": best.column("id"), "score": best.column("score")})
                yield from out.to_batches(max_chunksize=100_000)

        read, probed = index.lists, np.unique(lists).tolist()
        if len(probed) < len(index.centroids):
            read = read.where(F.col("list").isin(probed))
        return read.select("list", "id", "qv").mapInArrow(run, self._schema(index))


def exact_search(queries: DataFrame, index: InvertedLists, k: int = PARAGRAPHS_PER_QUESTION, probes: int = 2
                 ) -> tuple[DataFrame, float]:
    """(qid, id, score, rank) of the true ``k`` nearest vectors, and the share of (query, vector) pairs
    that never were compared.

    The ``probes`` nearest lists of a query give its k-th best score so far; of the others only those
    are read whose vectors can lie near enough. The queries must fit a broadcast (``exact_knn``
    takes more of them).
    """
    asked = _Carried(queries)
    if not len(asked.rows):
        return _final(asked.nothing(index), k), 0.0
    first = _probes(asked.rows, index, k, probes)
    found = asked.search(index, first, k).groupBy("qid", "id").agg(F.max("score").alias("score"))
    found = cut(_final(found, k))
    bound = {r["qid"]: r["score"] for r in found.where(F.col("rank") == k).select("qid", "score").collect()}  # one a query
    worst = np.array([bound.get(q, -np.inf) for q in asked.ids.to_pylist()])
    # no vector of a list lies nearer than the angle to its centroid less the list's width
    gap = np.maximum(_angles(_cosines(asked.rows, asked.norms, index.centroids)) - index.widths[None, :], 0)
    # a query or centroid without direction has cosine 0 to all, which is no angle
    free = (asked.norms == 0)[:, None] | (_norms(index.centroids) == 0)[None, :]
    open_ = (np.cos(gap) >= worst[:, None] - 1e-7) | free | (worst[:, None] <= 1e-7)
    for i, lists in enumerate(first):
        open_[i, lists] = False
    rest = [np.flatnonzero(row) for row in open_]
    compared = sum(index.sizes[x].sum() for part in (first, rest) for x in part)
    pruned = 1 - compared / max(1, index.sizes.sum() * len(asked.rows))
    if any(len(x) for x in rest):
        more = asked.search(index, rest, k).unionByName(found.select("qid", "id", "score"))
        found = _final(more.groupBy("qid", "id").agg(F.max("score").alias("score")), k)
    return found, float(pruned)


def _dealt_with_lists(queries: DataFrame, index: InvertedLists, k: int, probes: int, cell_rows: int) -> DataFrame:
    """Queries and vectors meet by list; a large list is cut by ids and its queries are copied."""
    qid_type, _ = _types(queries, index.lists)
    small = InvertedLists(None, index.centroids, index.sizes, index.widths, index.spill)
    parts = np.array([pieces_of(s, cell_rows) for s in index.sizes.tolist()])
    first = np.r_[0, np.cumsum(parts)]  # cells of a list
    sides = pieces_of(queries.count(), cell_rows)  # a list meets a bounded share of the queries at a time
    sent = queries.sparkSession.sparkContext.broadcast((small, first))

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, first = sent.value
        for batch in batches:
            if batch.num_rows:
                cells = [np.concatenate([np.arange(first[x], first[x + 1]) for x in lists.tolist()])
                         for lists in _probes(_matrix(batch.column("qv")), small, k, probes)]
                row = pa.array(np.repeat(np.arange(len(cells)), [len(x) for x in cells]))
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(row), batch.column("qv").take(row),
                                                  pa.array(np.concatenate(cells))], ["qid", "qv", "cell"])

    asked = queries.select("qid", "qv").mapInArrow(probing, f"qid {qid_type}, qv array<tinyint>, cell long")
    starts, counts = (F.array(*[F.lit(int(x)) for x in v]) for v in (first[:-1], parts))
    held = index.lists.withColumn("cell", F.get(starts, F.col("list")) + F.pmod(F.xxhash64("id"), F.get(counts, F.col("list"))))
    held = held.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(sides - 1)),
                                                         lambda side: (F.col("cell") * sides + side).cast("long"))))
    asked = asked.withColumn("cell", F.col("cell") * sides + F.pmod(F.xxhash64("qid"), F.lit(sides)))
    return _cells(*(side.withColumn("part", F.col("cell")) for side in (asked, held)), k)
