"""Nearest neighbours by cosine over int8 vectors.

Scores come from a block product: a bounded block of queries times a bounded block of vectors,
reduced at once to the best ``k`` per query, so the pairs themselves never become rows. Three
ways to lay out the blocks:

* few queries (their bytes are counted): they travel to every task and the vectors stay put;
* many queries: both sides are hashed into cells of bounded size, each cell one block;
* approximate: only pairs that share a bucket of random projections are scored. Few queries travel to
  the vectors with their bucket keys; for many, cells are the buckets, oversized ones split by salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import BROADCAST_LIMIT_BYTES, cut, parallel
from ..sources.tables import union_all
from .quantize import dequantize, same_length
from .topk import best_cells, best_rows, whole

PARAGRAPHS_PER_QUESTION = 10
SCORE_DIGITS = 9
QUERY_BLOCK = 1024
BLOCK_ROWS = 10_000
# Pairs scored at once: a matrix of them is held several times over.
BLOCK_PAIRS = 1 << 20
# Queries whose hits one task holds at a time.
GROUP_QUERIES = 16_384
CELL_ROWS = 50_000
# More than the error of a cosine in single precision and of its rounding.
FLOOR_SLACK = 1e-5
# Vectors matched with the queries' bucket keys at once, and pairs scored at once.
KEYED_ROWS, KEYED_PAIRS = 1_000, 32_000_000
PAIR_BLOCK = 100_000


def _matrix(lists: pa.Array) -> np.ndarray:
    """List column as a matrix. float32 holds int8 dot products exactly up to 1,024 dimensions."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = same_length(lists)
    integral = np.issubdtype(values.dtype, np.integer)
    return values.astype(np.float32 if integral and values.shape[1] <= 1024 else np.float64)


def _norms(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    return np.sqrt((wide * wide).sum(axis=1))


def _block_best(queries: np.ndarray, query_norms: np.ndarray, vectors: np.ndarray, ids: pa.Array,
                k: int, floor: np.ndarray | None = None) -> pa.Table:
    """Best ``k`` of one block of vectors for every query: ``q`` (row number), ``id``, ``score``.

    With ``floor``, scores that ``k`` hits of a query have reached already, all that may still reach it are
    returned, and only those are scored to the last digit.
    """
    norms = _norms(vectors)
    found = []
    inverse = np.divide(1.0, norms, out=np.zeros_like(norms), where=norms > 0).astype(queries.dtype)
    step = max(1, min(QUERY_BLOCK, BLOCK_PAIRS // max(1, len(vectors))))
    for at in range(0, len(queries), step):
        block = slice(at, at + step)
        if floor is not None:
            dots = queries[block] @ vectors.T
            least = ((floor[block] - FLOOR_SLACK) * query_norms[block]).astype(queries.dtype)
            q, v = np.nonzero(dots * inverse >= least[:, None])
            length = query_norms[q + at] * norms[v]
            score = np.divide(dots[q, v].astype(np.float64), length, out=np.zeros(len(q)), where=length > 0)
            score = np.rint(score * 10.0 ** SCORE_DIGITS) / 10.0 ** SCORE_DIGITS
            found.append(pa.table({"q": pa.array(q + at, pa.int64()), "id": ids.take(pa.array(v)), "score": score}))
            continue
        length = query_norms[block, None] * norms[None, :]
        dots = (queries[block] @ vectors.T).astype(np.float64)
        score = np.divide(dots, length, out=np.zeros_like(dots), where=length > 0)
        score = np.rint(score * 10.0 ** SCORE_DIGITS) / 10.0 ** SCORE_DIGITS
        found.append(best_cells(score, ids, k, first_q=at))
    return pa.concat_tables(found)


def _floor(best: pa.Table, queries: int, k: int) -> np.ndarray:
    """The ``k``-th score of each query among its ``best_rows``; below any cosine where there are fewer."""
    q, floor = best.column("q").to_numpy(), np.full(queries, -2.0)
    last = np.flatnonzero(q[k - 1:] == q[:max(0, len(q) - k + 1)]) + k - 1
    floor[q[last]] = best.column("score").to_numpy()[last]
    return floor


def _final(candidates: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id").asc())
    return (candidates.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("qid", "id", "score", "rank"))


def _types(queries: DataFrame, vectors: DataFrame) -> tuple[str, str]:
    return (queries.schema["qid"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString())


def _carried(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Candidates with the (counted, bounded) queries sent to every task."""
    table = queries.select("qid", "qv").toArrow()
    qid_type, id_type = _types(queries, vectors)
    if table.num_rows == 0:
        return queries.sparkSession.createDataFrame([], f"qid {qid_type}, id {id_type}, score double")
    query_ids, matrix = whole(table.column("qid")), _matrix(table.column("qv"))

    def searched(ids: pa.Array, asked: np.ndarray) -> DataFrame:
        sent = queries.sparkSession.sparkContext.broadcast((ids, asked, _norms(asked)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids_of, rows, norms = sent.value
            best = None
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                floor = None if best is None else _floor(best, len(rows), k)
                new = _block_best(rows, norms, _matrix(batch.column(1)), batch.column(0), k, floor)
                best = new if best is None else best_rows(pa.concat_tables([best, new]), k)
            if best is not None:
                out = pa.table({"qid": ids_of.take(whole(best.column("q"))), "id": best.column("id"),
                                "score": best.column("score")})
                yield from out.to_batches(max_chunksize=100_000)

        return vectors.select("id", "qv").mapInArrow(run, f"qid {qid_type}, id {id_type}, score double")

    # the hits that a task holds follow a group of the queries, not all of them
    return union_all([searched(query_ids.take(pa.array(np.arange(at, min(at + GROUP_QUERIES, len(matrix))))), matrix[at:at + GROUP_QUERIES])
                      for at in range(0, len(matrix), GROUP_QUERIES)])


def _cells(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Candidates from co-grouped rows: both sides carry ``cell`` and ``part``.

    Rows meet when their ``cell`` is equal. A ``part`` is the group one call gets: one cell, or
    as many small ones as fill it.
    """
    qid_type, id_type = _types(queries, vectors)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best = pa.table({"q": pa.array([], pa.int64()), "id": right.column("id").slice(0, 0),
                         "score": pa.array([], pa.float64())})
        found = [best]
        if left.num_rows and right.num_rows:
            left, right = (t.take(pc.sort_indices(t.column("cell"))) for t in (left, right))
            rows, columns = _matrix(left.column("qv")), _matrix(right.column("qv"))
            norms, ids = _norms(rows), whole(right.column("id"))
            cells, here = left.column("cell").to_numpy(), right.column("cell").to_numpy()
            for cell in np.intersect1d(cells, here):
                begin, stop = np.searchsorted(here, cell), np.searchsorted(here, cell, "right")
                last = np.searchsorted(cells, cell, "right")
                for lo in range(np.searchsorted(cells, cell), last, GROUP_QUERIES):
                    hi, mine = min(lo + GROUP_QUERIES, last), None
                    for at in range(begin, stop, BLOCK_ROWS):
                        end = min(at + BLOCK_ROWS, stop)
                        new = _block_best(rows[lo:hi], norms[lo:hi], columns[at:end], ids.slice(at, end - at), k)
                        mine = new if mine is None else best_rows(pa.concat_tables([mine, new]), k)
                    found.append(mine.set_column(0, "q", pc.add(mine.column("q"), int(lo))))
            best = best_rows(pa.concat_tables(found), k)
        return pa.table({"qid": whole(left.column("qid")).take(whole(best.column("q"))),
                         "id": best.column("id"), "score": best.column("score")})

    # fresh names on both sides: queries are often drawn from the vectors themselves
    return (queries.select(*[F.col(c).alias(c) for c in ["part", "cell", "qid", "qv"]]).groupBy("part")
            .cogroup(vectors.select(*[F.col(c).alias(c) for c in ["part", "cell", "id", "qv"]]).groupBy("part"))
            .applyInArrow(run, f"qid {qid_type}, id {id_type}, score double"))


def _parts(rows: int, cell_rows: int) -> int:
    return max(1, -(-rows // cell_rows))


def _hashed_cells(queries: DataFrame, vectors: DataFrame, k: int, cell_rows: int) -> DataFrame:
    q_parts = _parts(queries.count(), cell_rows)
    v_parts = _parts(vectors.count(), cell_rows)
    cell = (F.col("q_part") * v_parts + F.col("v_part")).cast("long")
    q = (queries.withColumn("q_part", F.pmod(F.xxhash64("qid"), F.lit(q_parts)))
         .withColumn("v_part", F.explode(F.sequence(F.lit(0), F.lit(v_parts - 1)))))
    v = (vectors.withColumn("v_part", F.pmod(F.xxhash64("id"), F.lit(v_parts)))
         .withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1)))))
    return _cells(*(side.withColumns({"cell": cell, "part": cell}) for side in (q, v)), k)


def exact_knn(queries: DataFrame, vectors: DataFrame, k: int = PARAGRAPHS_PER_QUESTION,
              calibration: DataFrame | None = None, broadcast_limit: int = BROADCAST_LIMIT_BYTES,
              cell_rows: int = CELL_ROWS) -> DataFrame:
    """(qid, id, score, rank): the ``k`` nearest of ``vectors(id, qv)`` to each ``queries(qid, qv)``.

    Cosine of the raw int8 values; a zero vector scores 0. With ``calibration`` both sides are
    scored on their dequantized values instead, which undoes the bend of angles that the offset
    of each dimension brings.
    """
    if calibration is not None:
        queries = dequantize(queries.withColumnRenamed("qid", "id"), calibration).select(
            F.col("id").alias("qid"), F.col("embedding").alias("qv"))
        vectors = dequantize(vectors, calibration).select("id", F.col("embedding").alias("qv"))
    # 8 bytes an element on the Python side
    needed = queries.agg(F.sum(F.size("qv") * 8 + 64).alias("bytes")).first()["bytes"] or 0
    if needed <= broadcast_limit:
        return _final(_carried(queries, vectors, k), k)
    return _final(_hashed_cells(queries, vectors, k, cell_rows), k)


def nearest_self(vectors: DataFrame) -> DataFrame:
    """Known-item check: (id, nearest_id, score, found) where a vector is its own query.

    ``found`` holds when no other vector scores higher than the vector itself.
    """
    queries = vectors.select(F.col("id").alias("qid"), "qv")
    hits = exact_knn(queries, vectors, 1)
    own = F.round(F.when(F.exists("qv", lambda x: x != 0), F.lit(1.0)).otherwise(0.0), SCORE_DIGITS)
    return (vectors.select(F.col("id").alias("qid"), own.alias("own"))
            .join(hits, "qid")
            .select(F.col("qid").alias("id"), F.col("id").alias("nearest_id"), "score",
                    (F.col("score") == F.col("own")).alias("found")))


# --- approximate ----------------------------------------------------------------------------

def _projections(dims: int, tables: int, projections: int, seed: int) -> np.ndarray:
    """Random unit directions, (dims, tables * projections)."""
    drawn = np.random.default_rng(seed).normal(size=(dims, tables * projections))
    return drawn / np.sqrt((drawn * drawn).sum(axis=0))


def _bucket_keys(rows: np.ndarray, directions: np.ndarray, tables: int, bucket_length: float) -> np.ndarray:
    """One number per row and hash table, for the cut projections of the unit vector. Where two buckets
    get one number, their rows are scored together."""
    norms = _norms(rows)
    unit = np.divide(rows, norms[:, None], out=np.zeros(rows.shape), where=norms[:, None] > 0)
    cells = np.floor(unit @ directions / bucket_length).astype(np.int64).reshape(len(rows), tables, -1)
    key = np.broadcast_to(np.arange(tables, dtype=np.uint64), cells.shape[:2]).copy()
    for j in range(cells.shape[2]):
        key = (key ^ cells[:, :, j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _pair_scores(queries, query_norms, vectors, q, v) -> np.ndarray:
    """Scores of listed pairs."""
    norms, score = _norms(vectors), np.zeros(len(q))
    if 5 * len(q) > len(queries) * len(vectors):  # most pairs: one block product
        dots = (queries @ vectors.T)[q, v].astype(np.float64)
        length = query_norms[q] * norms[v]
        score = np.divide(dots, length, out=score, where=length > 0)
        return np.rint(score * 10.0 ** SCORE_DIGITS) / 10.0 ** SCORE_DIGITS
    for at in range(0, len(q), PAIR_BLOCK):
        x, y = q[at:at + PAIR_BLOCK], v[at:at + PAIR_BLOCK]
        dots = np.einsum("ij,ij->i", queries[x], vectors[y]).astype(np.float64)
        length = query_norms[x] * norms[y]
        score[at:at + PAIR_BLOCK] = np.divide(dots, length, out=np.zeros(len(x)), where=length > 0)
    return np.rint(score * 10.0 ** SCORE_DIGITS) / 10.0 ** SCORE_DIGITS


def lsh_knn(queries: DataFrame, vectors: DataFrame, k: int = PARAGRAPHS_PER_QUESTION,
            bucket_length: float = 0.5, tables: int = 16, projections: int = 3, seed: int = 42,
            cell_rows: int = CELL_ROWS, broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Approximate neighbours without a stored index: only vectors that share a bucket with the query
    are scored, exactly. A query may have fewer than ``k`` such vectors; ``inverted_lists`` never has.

    ``tables`` independent hash tables, each keyed by ``projections`` random projections of the
    unit vector cut every ``bucket_length``. Few queries (counted) travel to the vectors with their keys
    and nothing is shuffled but the hits. Otherwise rows meet by bucket; one with more rows than
    ``cell_rows`` on a side is split on that side into salts, and the other side is copied to each.
    """
    first = vectors.select(F.size("qv").alias("dims")).first()
    if first is None:
        qid_type, id_type = _types(queries, vectors)
        return vectors.sparkSession.createDataFrame([], f"qid {qid_type}, id {id_type}, score double, rank int")
    directions = _projections(first["dims"], tables, projections, seed)
    needed = queries.agg(F.sum(F.size("qv") * 8 + 64 + 16 * tables).alias("bytes")).first()["bytes"] or 0
    if needed <= broadcast_limit:
        return _final(_carried_with_keys(queries, vectors, k, directions, tables, bucket_length), k)
    cores = parallel(vectors.sparkSession)
    q = _buckets(queries, "qid", directions, tables, bucket_length)
    v = _buckets(vectors, "id", directions, tables, bucket_length)
    busy = _busy(q, "q_salts", cell_rows).join(_busy(v, "v_salts", cell_rows), "bucket", "full")
    # Each entry stands for more than cell_rows rows of a side: at most rows * tables / cell_rows.
    busy = cut(busy)
    q, v = (side.join(busy, "bucket", "left")
            .withColumns({"q_salts": F.coalesce("q_salts", F.lit(1)), "v_salts": F.coalesce("v_salts", F.lit(1))})
            for side in (q, v))
    q = (q.withColumn("q_salt", F.pmod(F.xxhash64("qid"), F.col("q_salts")).cast("int"))
         .withColumn("v_salt", F.explode(F.sequence(F.lit(0), F.col("v_salts") - 1))))
    v = (v.withColumn("v_salt", F.pmod(F.xxhash64("id"), F.col("v_salts")).cast("int"))
         .withColumn("q_salt", F.explode(F.sequence(F.lit(0), F.col("q_salts") - 1))))
    # packed into parts of about cell_rows rows
    parts = _parts((queries.count() + vectors.count()) * tables, cell_rows)
    cell = F.xxhash64("bucket", "q_salt", "v_salt")
    found = _cells(*(side.withColumn("cell", cell).withColumn("part", F.pmod("cell", F.lit(max(parts, cores))))
                     for side in (q, v)), k)
    # an id met in several tables has the same score in each
    return _final(found.groupBy("qid", "id").agg(F.max("score").alias("score")), k)


def _carried_with_keys(queries: DataFrame, vectors: DataFrame, k: int, directions: np.ndarray, tables: int,
                       bucket_length: float) -> DataFrame:
    table = queries.select("qid", "qv").toArrow()
    qid_type, id_type = _types(queries, vectors)
    schema = f"qid {qid_type}, id {id_type}, score double"
    if table.num_rows == 0:
        return queries.sparkSession.createDataFrame([], schema)
    query_ids, matrix = whole(table.column("qid")), _matrix(table.column("qv"))
    keys = _bucket_keys(matrix, directions, tables, bucket_length)
    order = np.argsort(keys, axis=0, kind="stable")
    sent = queries.sparkSession.sparkContext.broadcast(
        (query_ids, matrix, _norms(matrix), np.take_along_axis(keys, order, 0).T.copy(), order.T.copy(), directions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, norms, known, owner, directions = sent.value
        best = None
        for batch in batches:
            step = max(1, min(KEYED_ROWS, KEYED_PAIRS // len(rows)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                here = _matrix(part.column(1))
                keys = _bucket_keys(here, directions, tables, bucket_length)
                met = np.zeros(len(rows) * len(here), bool)  # a pair of several tables counts once
                for t in range(tables):
                    lo, hi = (np.searchsorted(known[t], keys[:, t], side=s) for s in ("left", "right"))
                    n = hi - lo
                    v = np.repeat(np.arange(len(here)), n)
                    q = owner[t][np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n) + lo[v]]
                    met[q * len(here) + v] = True
                pairs = np.flatnonzero(met)
                q, v = pairs // len(here), pairs % len(here)
                new = pa.table({"q": pa.array(q, pa.int64()), "id": part.column(0).take(pa.array(v)),
                                "score": _pair_scores(rows, norms, here, q, v)})
                best = best_rows(new if best is None else pa.concat_tables([best, new]), k)
        if best is not None:
            out = pa.table({"qid": names.take(whole(best.column("q"))), "id": best.column("id"), "score": best.column("score")})
            yield from out.to_batches(max_chunksize=100_000)

    return vectors.select("id", "qv").mapInArrow(run, schema)


def _buckets(rows: DataFrame, key: str, directions: np.ndarray, tables: int, bucket_length: float) -> DataFrame:
    """(key, qv, bucket): one row per hash table."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _bucket_keys(_matrix(batch.column(1)), directions, tables, bucket_length)
                row = pa.array(np.repeat(np.arange(batch.num_rows), tables))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(keys.ravel())], [key, "qv", "bucket"])

    return rows.select(key, "qv").mapInArrow(run, f"{key} {kind}, qv array<tinyint>, bucket long")


def _busy(side: DataFrame, name: str, cell_rows: int) -> DataFrame:
    return (side.groupBy("bucket").agg(F.count("*").alias("n"))
            .where(F.col("n") > cell_rows)
            .select("bucket", F.ceil(F.col("n") / cell_rows).cast("int").alias(name)))
