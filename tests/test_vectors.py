"""Embedding, calibration, int8 vectors, nearest neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.functions import encoders
from ragspark.operators import inverted_lists, knn, quantize


def _floats(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)],
                                 "id INT, embedding ARRAY<FLOAT>")


def _bytes(spark, matrix, key="id"):
    return spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(matrix)],
                                 f"{key} INT, qv ARRAY<TINYINT>")


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([("a", "One two, two!"), ("b", ""), ("c", "two one TWO"), ("d", None)],
                                 "pid STRING, text STRING")
    got = {r.id: np.array(r.embedding) for r in encoders.embed(rows, "pid", "text").collect()}
    assert set(got) == {"a", "b", "c"} and len(got["a"]) == encoders.DIMS
    assert np.linalg.norm(got["a"]) == pytest.approx(1.0, abs=1e-6)
    assert not got["b"].any() and (got["a"] == got["c"]).all()


def test_encoder_of_the_caller_is_made_once_per_task(spark):
    def factory():
        calls = []

        def encode(texts):
            calls.append(1)
            return np.array([[len(t), len(calls)] for t in texts.to_pylist()], dtype=np.float32)
        return encode
    rows = spark.createDataFrame([(i, "x" * i) for i in range(40)], "i INT, t STRING").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {r.id: r.embedding for r in encoders.embed(rows, "i", "t", factory).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i][0] for i in range(40)] == list(range(40))
    assert {got[i][1] for i in range(40)} == {1.0, 2.0, 3.0, 4.0}


def test_quantization_edges(spark):
    corpus = _floats(spark, [[0.0, 5.0, -1.0], [1.0, 5.0, 1.0], [0.5, 5.0, 0.0]])
    ranges = quantize.calibrate(corpus)
    assert {r.dim: (r.lo, r.hi) for r in ranges.collect()} == {0: (0, 1), 1: (5, 5), 2: (-1, 1)}
    got = {r.id: r.qv for r in quantize.quantize(corpus, ranges).collect()}
    assert got[0] == [-128, 0, -128] and got[1] == [127, 0, 127] and got[2][0] == 0  # trunc(-0.5)
    asked = _floats(spark, [[-9.0, 9.0, 9.0]])
    assert quantize.quantize(asked, ranges).first().qv == [-128, 0, 127]
    back = {r.id: r.embedding for r in quantize.dequantize(quantize.quantize(corpus, ranges), ranges).collect()}
    assert back[1][0] == pytest.approx(1.0) and back[0][2] == pytest.approx(-1.0) and back[2][1] == 5.0


def test_quantization_of_irregular_vectors(spark):
    """What the column expressions of the general form give, also where elements or ranges are missing."""
    rows = spark.createDataFrame([(0, [0.0, 1.0, 5.0]), (1, [2.0, None, None]), (2, [1.0]), (3, None),
                                  (4, [1.0, 1.0, 5.0, 7.0]), (5, [float("nan"), float("-inf"), 9.0]), (6, [])],
                                 "id INT, embedding ARRAY<DOUBLE>")
    ranges = spark.createDataFrame([(0, 0.0, 2.0), (1, -1.0, 1.0), (2, 5.0, 5.0)], quantize.CALIBRATION_SCHEMA)
    got = {r.id: r.qv for r in quantize.quantize(rows, ranges).collect()}
    assert got == {0: [-128, 127, 0], 1: [127, -128, 0], 2: [0, -128, 0], 3: None, 4: [0, 127, 0, -128],
                   5: [127, -128, 0], 6: [-128, -128, 0]}


def test_index_is_made_in_few_scans_without_row_wise_lambdas(spark, tmp_path):
    """Interpreted lambdas over 384 elements a vector took half of the paragraph index."""
    matrix = np.random.default_rng(5).normal(size=(300, 16))
    floats = _floats(spark, matrix)
    index, ranges = quantize.save_vector_index(floats, str(tmp_path / "vectors"))
    plan = quantize.index_rows(floats, ranges)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan
    counts = spark.read.parquet(str(tmp_path / "vectors" / "validation")).first()
    assert (counts.dims, counts.accepted, counts.rejected) == (16, 300, 0)
    want = {r.id: (r.qv, r.norm) for r in quantize.with_norm(quantize.quantize(floats, quantize.calibrate(floats))).collect()}
    assert {r.id: (r.qv, r.norm) for r in index.collect()} == want
    assert sorted(map(tuple, ranges.collect())) == sorted(map(tuple, quantize.calibrate(floats).collect()))


def test_packed_floats_give_the_same_index(spark, tmp_path):
    """The stored floats of the paragraphs were written and read number by number."""
    rows = spark.createDataFrame([(i, " ".join(f"w{i * j % 17}" for j in range(i % 9))) for i in range(60)], "id INT, text STRING")
    plain, packed = (encoders.embed(rows, "id", "text", dims=24, packed=p) for p in (False, True))
    assert packed.schema["embedding"].dataType.simpleString() == "binary"
    short = packed.where("id = 3").select(F.lit(99).alias("id"), F.substring("embedding", 1, 40).alias("embedding"))
    null = packed.where("id = 3").select(F.lit(98).alias("id"), F.lit(None).cast("binary").alias("embedding"))
    made = {name: quantize.save_vector_index(vectors, str(tmp_path / name)) for name, vectors in
            (("plain", plain), ("packed", packed.unionByName(short).unionByName(null).coalesce(1)))}
    told = {name: (sorted(map(tuple, index.collect())), sorted(map(tuple, ranges.collect()))) for name, (index, ranges) in made.items()}
    assert told["plain"] == told["packed"] and len(told["plain"][0]) == 60
    assert tuple(spark.read.parquet(str(tmp_path / "packed" / "validation")).first()) == (24, 60, 2)


def test_ranges_per_batch(spark):
    rows = spark.createDataFrame([(0, [1.0]), (0, [3.0]), (1, [7.0])], "b INT, embedding ARRAY<FLOAT>")
    got = {(r.batch, r.dim): (r.lo, r.hi) for r in quantize.calibrate(rows, "b").collect()}
    assert got == {(0, 0): (1.0, 3.0), (1, 0): (7.0, 7.0)}


def test_contract(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, None],), (None,)], "embedding ARRAY<FLOAT>")
    assert quantize.validation_counts(rows, 2).first().asDict() == {"dims": 2, "accepted": 1, "rejected": 3}


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(5)
    m = rng.integers(-128, 128, (400, 24))
    m[10] = 0
    m[100:250] = m[99]          # a group of copies holds more than a third of the rows
    return m


def _want(q, v, k):
    nq, nv = (np.sqrt((x.astype(float) ** 2).sum(1)) for x in (q, v))
    length = nq[:, None] * nv[None]
    s = np.round(np.divide(q @ v.T, length, out=np.zeros(length.shape), where=length > 0), 9)
    order = np.lexsort((np.broadcast_to(np.arange(len(v)), s.shape), -s))[:, :k]
    return {(i, int(j), r + 1): s[i, j] for i, row in enumerate(order) for r, j in enumerate(row)}


@pytest.mark.parametrize("how", [{}, {"broadcast_limit": 0}, {"broadcast_limit": 0, "cell_rows": 37}])
def test_exact_neighbours_equal_brute_force(spark, matrix, how):
    q, v = _bytes(spark, matrix[:60], "qid"), _bytes(spark, matrix).repartition(5)
    got = {(r.qid, r.id, r["rank"]): r.score for r in knn.exact_knn(q, v, 7, **how).collect()}
    want = _want(matrix[:60], matrix, 7)
    assert got.keys() == want.keys()
    assert all(abs(got[key] - want[key]) < 2e-9 for key in want)


def test_small_inputs(spark, matrix):
    v = _bytes(spark, matrix[:3])
    q = v.select(F.col("id").alias("qid"), "qv")
    assert knn.exact_knn(q, v, 10).count() == 9
    assert knn.exact_knn(q.limit(0), v, 10).count() == 0
    assert knn.exact_knn(q, v.limit(0), 10).count() == 0


def test_every_vector_finds_itself(spark, matrix):
    rows = knn.nearest_self(_bytes(spark, matrix)).collect()
    assert len(rows) == 400 and all(r.found for r in rows)
    assert {r.nearest_id for r in rows if 99 <= r.id < 250} == {99}


def test_a_floor_keeps_every_hit():
    """Blocks after the first score only what may reach the k-th score so far; ties and zero vectors stay."""
    import pyarrow as pa
    from ragspark.operators.topk import best_rows
    rng = np.random.default_rng(4)
    data = rng.integers(-128, 128, (900, 64)).astype(np.float32)
    data[::7], data[450:460] = data[3], 0
    asked, ids = np.r_[data[:40], data[455:456]], pa.array(np.arange(900))
    norms, best, scored = knn._norms(asked), None, 0
    for at in range(0, 900, 100):
        floor = None if best is None else knn._floor(best, len(asked), 10)
        new = knn._block_best(asked, norms, data[at:at + 100], ids.slice(at, 100), 10, floor)
        scored += new.num_rows if at else 0
        best = best_rows(new if best is None else pa.concat_tables([best, new]), 10)
    assert best.to_pylist() == best_rows(knn._block_best(asked, norms, data, ids, 10), 10).to_pylist()
    assert scored < 41 * 800 / 4
    assert (knn._floor(best.slice(0, 8), 41, 10) == -2).all()


def test_approximate_is_exact_within_buckets(spark, matrix):
    rng = np.random.default_rng(6)
    centers = rng.integers(-100, 100, (20, 24))
    data = np.clip(np.repeat(centers, 20, 0) + rng.integers(-12, 13, (400, 24)), -128, 127)
    data[:150] = data[0]        # hot bucket
    v = _bytes(spark, data)
    q = v.select(F.col("id").alias("qid"), "qv")
    want = _want(data, data, 5)
    score = {(a, b): s for (a, b, _), s in want.items()}
    got = knn.lsh_knn(q, v, 5, bucket_length=0.6, tables=12, projections=2).collect()
    split = knn.lsh_knn(q, v, 5, bucket_length=0.6, tables=12, projections=2, cell_rows=40).collect()
    many = knn.lsh_knn(q, v, 5, bucket_length=0.6, tables=12, projections=2, cell_rows=40, broadcast_limit=0).collect()
    assert sorted(got) == sorted(split) == sorted(many)     # neither layout nor salting changes anything
    hit = sum((r.qid, r.id) in score for r in got)
    assert hit / len(want) >= 0.95
    assert all(abs(score[r.qid, r.id] - r.score) < 2e-9 for r in got if (r.qid, r.id) in score)


def test_dequantized_scores_follow_the_floats(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(300, 16)) + np.linspace(-2, 2, 16)
    floats = _floats(spark, data)
    ranges = quantize.calibrate(floats)
    v = quantize.quantize(floats, ranges)
    q = v.select(F.col("id").alias("qid"), "qv")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit.T), axis=1)[:, :10]
    got = {(r.qid, r.id) for r in knn.exact_knn(q, v, 10, calibration=ranges).collect()}
    assert np.mean([(i, int(j)) in got for i in range(300) for j in best[i]]) > 0.97


# --- stored lists ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(6)
    centers = rng.integers(-100, 100, (12, 24))
    data = np.clip(np.repeat(centers, 50, 0) + rng.integers(-40, 41, (600, 24)), -128, 127)
    data[:200] = data[0]  # a third of all vectors are one
    data[599] = 0
    return data


@pytest.mark.parametrize("how", [{}, {"broadcast_limit": 0, "cell_rows": 30}])
def test_lists_find_almost_all_neighbours(spark, clustered, tmp_path, how):
    v = _bytes(spark, clustered).repartition(4)
    q = _bytes(spark, clustered[195:300], "qid")
    index = inverted_lists.save_lists(v, str(tmp_path / "lists"))
    assert index.sizes.sum() == 2 * 600
    got = inverted_lists.search_lists(q, index, 5, probes=4, **how).collect()
    assert len(got) == 5 * 105  # none comes up short
    want = _want(clustered[195:300], clustered, 5)
    score = {(a, b): s for (a, b, _), s in want.items()}
    found = [(r.qid, r.id) for r in got if (r.qid, r.id) in score]
    assert len(set(found)) / len(want) >= 0.95
    assert all(abs(score[r.qid, r.id] - r.score) < 2e-9 for r in got if (r.qid, r.id) in score)
    every = inverted_lists.search_lists(q, index, 5, probes=len(index.centroids), **how).collect()
    assert {(r.qid, r.id, r["rank"]) for r in every} == set(want)


def test_exact_search_leaves_most_lists_alone(spark, clustered, tmp_path):
    near = np.clip(np.rint(clustered * 0.9 + np.random.default_rng(1).integers(-3, 4, clustered.shape)), -128, 127)
    near[0] = 0     # no direction: all are equally near
    v, q = _bytes(spark, clustered).repartition(4), _bytes(spark, near[::7], "qid")
    index = inverted_lists.save_lists(v, str(tmp_path / "lists"))
    found, pruned = inverted_lists.exact_search(q, index, 5)
    want = _want(near[::7], clustered, 5)
    got = {(r.qid, r.id, r["rank"]): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-9 for x in want)
    assert pruned > 0.5
    assert inverted_lists.exact_search(q.limit(0), index, 5)[0].count() == 0


def test_lists_are_read_where_probed(spark, clustered, tmp_path):
    v = _bytes(spark, clustered)
    index = inverted_lists.save_lists(v, str(tmp_path / "lists"), lists=20, rounds=3)
    plan = inverted_lists.search_lists(_bytes(spark, clustered[400:401], "qid"), index, 2, probes=2)
    assert "PartitionFilters: [list" in plan._jdf.queryExecution().executedPlan().toString()
    again = inverted_lists.save_lists(v.limit(1), str(tmp_path / "lists"))  # what is there stays
    assert again.sizes.tolist() == index.sizes.tolist()


def test_lists_of_few_vectors(spark, clustered, tmp_path):
    index = inverted_lists.save_lists(_bytes(spark, clustered[300:303]), str(tmp_path / "a"))
    q = _bytes(spark, clustered[300:302], "qid")
    assert inverted_lists.search_lists(q, index, 10, probes=1).count() == 6
    assert inverted_lists.search_lists(q.limit(0), index, 10).count() == 0
    empty = inverted_lists.save_lists(_bytes(spark, clustered[:1]).limit(0), str(tmp_path / "b"))
    assert inverted_lists.search_lists(q.limit(0), empty, 10).count() == 0


def test_ragged_vectors_are_left_out_and_counted(spark, tmp_path):
    rows = [(i, [float(i), 1.0, -2.0]) for i in range(6)] + [(7, [1.0]), (8, None), (9, [1.0, None, 2.0]), (10, [99.0] * 4)]
    floats = spark.createDataFrame(rows, "id long, embedding array<float>")
    index, ranges = quantize.save_vector_index(floats, str(tmp_path / "ix"))
    assert {r["id"] for r in index.collect()} == set(range(6)) and ranges.count() == 3
    counts = spark.read.parquet(str(tmp_path / "ix/validation")).first()
    assert (counts["dims"], counts["accepted"], counts["rejected"]) == (3, 6, 4)
    with pytest.raises(Exception, match="different lengths"):
        quantize.calibrate(floats).collect()


def test_hits_of_a_task_follow_a_group_of_queries(spark, clustered, tmp_path, monkeypatch):
    v, q = _bytes(spark, clustered).repartition(4), _bytes(spark, clustered[195:300], "qid")
    index = inverted_lists.save_lists(v, str(tmp_path / "lists"))
    want = set(_want(clustered[195:300], clustered, 5))
    held = []

    real = type(spark).sparkContext.fget
    for module in (knn, inverted_lists):
        monkeypatch.setattr(module, "GROUP_QUERIES", 40)
    monkeypatch.setattr(type(spark), "sparkContext", property(lambda self: _Watched(real(self), held)))
    found = [knn.exact_knn(q, v, 5), inverted_lists.search_lists(q, index, 5, probes=len(index.centroids)),
             inverted_lists.exact_search(q, index, 5)[0]]
    monkeypatch.undo()
    assert all({(r.qid, r.id, r["rank"]) for r in rows.collect()} == want for rows in found)
    assert held and max(len(value[0]) for value in held) <= 40


class _Watched:
    def __init__(self, context, held):
        self.context, self.held = context, held

    def broadcast(self, value):
        self.held.append(value)
        return self.context.broadcast(value)

    def __getattr__(self, name):
        return getattr(self.context, name)
