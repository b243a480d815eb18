"""Periodic runs, language identification and centroid clusters against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("ragspark.llm")
from ragspark.llm import byte_cnn, periodic_runs, simplex_kmeans  # noqa: E402

# --- 11 -----------------------------------------------------------------------------------------


def _runs(words, least=12):
    """All runs by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_words(least):
    random_ = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(random_.randint(1, 4)):
            words = [random_.randrange(random_.choice([1, 2, 3])) for _ in range(random_.randint(0, 60))]
            if words and random_.random() < 0.5:
                a, p = random_.randrange(len(words)), random_.randint(1, 9)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
            texts.append(words)
        bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        start, length, period = periodic_runs.word_runs(np.array(sum(texts, []), np.int64), bounds, least)
        want = [(b + s, n, q) for b, t in zip(bounds.tolist(), texts) for s, n, q in _runs(t, least)]
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want


def test_words_are_split_at_ascii_space_only():
    words, bounds = periodic_runs.split_words(pa.array(["a  b\x0b\x0cc\x1cd \xa0 é\x85f ", "", None, " \n", "x"]))
    assert words.to_pylist() == ["a", "b", "c\x1cd", "\xa0", "é\x85f", "x"] and bounds.tolist() == [0, 5, 5, 5, 5, 6]


def test_long_runs_are_quick():
    codes = np.arange(200_000, dtype=np.int64) % 7
    assert [x.tolist() for x in periodic_runs.word_runs(codes, np.array([0, 200_000]))] == [[0], [200_000], [7]]


RUN_TEXTS = [(0, "a b c " * 10), (10, " ".join(f"w{i}" for i in range(50))), (None, "x " * 20), (3, None), (4, ""),
             (5, " \n\t "), (6, "one two"), (6, "one two"), (7, "Word " * 3_000 + "end"), (8, "p q " * 9 + "z " * 30)]
RUN_TEXTS += [(i, " ".join(f"v{(i * j) % 23}" for j in range(40 + i))) for i in range(20, 60)]


def _digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_digests(spark):
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in RUN_TEXTS if i is not None)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in RUN_TEXTS], "doc_id long, text string, runs int, n_words string")
    found = periodic_runs.digests(periodic_runs.find_runs(docs.repartition(3), rearrange=periodic_runs.periodic_tail))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                             "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((_digest(i, t) for i, t in RUN_TEXTS), key=str)
    nothing = docs.where("false")
    assert periodic_runs.digests(periodic_runs.find_runs(nothing)).collect() == []


# --- 12 -----------------------------------------------------------------------------------------

SYLLABLES = {"aa": ["tion", "the", "ing", "wh"], "bb": ["sch", "ung", "ei", "ü"], "cc": ["eau", "é", "que", "oi"]}


def _sentence(random_, lang):
    return " ".join("".join(random_.choice(SYLLABLES[lang]) for _ in range(random_.randint(1, 3))) for _ in range(30))


@pytest.fixture(scope="module")
def spoken(spark):
    random_ = random.Random(5)
    rows = [(i, _sentence(random_, lang), lang) for i in range(240) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, " 12 ½ $", "cc"), (1003, "eau que " * 40_000, None),
             (None, "the whing tion", "aa"), (1004, rows[1][1], "bb"), (1004, rows[1][1], "bb")]
    return spark.createDataFrame([(*r, "s", 0.5, True) for r in rows],
                                 "doc_id long, text string, lang string, key string, score double, windows boolean").cache()


def test_languages_of_held_out_texts(spark, spoken):
    found = byte_cnn.languages(spoken)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == spoken.count()
    truth = {r["doc_id"]: r["lang"] for r in spoken.where("doc_id < 1000").collect()}
    mine = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 1000 and r["held_out"]]
    assert len(mine) > 30 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in mine)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in mine]) > 0.97
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[1003]["lang_pred"] == "cc" and by_id[None]["held_out"] is False
    twice = [r for r in rows if r["doc_id"] == 1004]
    assert twice[0] == twice[1] and all(0 <= r["score"] <= 1 for r in rows)


def test_languages_without_labels(spark, spoken):
    rows = byte_cnn.languages(spoken.withColumn("lang", spoken["lang"].substr(9, 1)).limit(5).drop("lang")
                              .selectExpr("*", "cast(null as string) as lang")).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)] * 5
    assert byte_cnn.languages(spoken.where("false")).collect() == []


def test_every_byte_is_in_a_window():
    for size in (1, 255, 256, 257, 300, 508, 509, 5_000):
        text, start = byte_cnn._starts(np.array([0, 3, 3 + size]))
        ends = np.minimum(start[text == 1] + byte_cnn.WINDOW, 3 + size)
        assert start[text == 1][0] == 3 and ends[-1] == 3 + size
        assert (np.diff(start[text == 1]) == byte_cnn.WINDOW - max(byte_cnn.WIDTHS) + 1).all()


# --- 13 -----------------------------------------------------------------------------------------

def _clusters(rows, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            top = [float(x).as_integer_ratio() for x in v]
            kept.append((i, [1024 * a // b for a, b in top]))
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in kept[:8]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        groups = {}
        for (_, v), (_, j) in zip(kept, assign()):
            groups.setdefault(j, []).append(v)
        for j, members in groups.items():
            centres[j] = [sum(x) // len(members) for x in zip(*members)]
    found = assign()
    sums = {}
    for d, j in found:
        sums[j] = sums.get(j, 0) + d
    most = 2**63 - 1
    return sorted(((i, j, min(d, most), min(sums[j], most), min(sum(sums.values()), most),
                    hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, found)), key=str)


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                                 "vec_id long, embedding array<double>, cluster int, packed string").repartition(3)


def _points(n, seed=4):
    random_ = random.Random(seed)
    centres = [[random_.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [x + random_.gauss(0, 0.2) for x in random_.choice(centres)]) for i in range(n)]


def _found(spark, rows):
    df = simplex_kmeans.centroid_clusters(_vectors(spark, rows))
    assert df.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = df.collect()
    return sorted((tuple(r)[:6] for r in got), key=str), got


def test_clusters_equal_brute_force(spark):
    rows = _points(120)
    rows += [(200, None), (201, [1.0] * 63), (202, [1.0] * 65), (203, [None] + [1.0] * 63),
             (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63), (7, rows[7][1]), (7, rows[7][1]),
             (None, rows[3][1]), (206, [0.0] * 64), (207, [-1e-9] * 64)]
    got, raw = _found(spark, rows)
    assert got == _clusters(rows)
    assert np.mean([r["compared"] for r in raw]) < 4  # clusters lie apart: most centroids are put aside


def test_clusters_of_huge_components(spark):
    rows = _points(30) + [(100, [3e5] * 64), (101, [-2.5e300] + [1.0] * 63), (102, [1e12] * 64)]
    assert _found(spark, rows)[0] == _clusters(rows)


def test_few_equal_and_no_vectors(spark):
    few = _points(3)
    assert _found(spark, few)[0] == _clusters(few)
    equal = [(i, [0.5] * 64) for i in range(12)]
    assert _found(spark, equal)[0] == _clusters(equal)
    assert _found(spark, [])[0] == []


def test_bounds_hold():
    points = np.random.default_rng(1).integers(-900, 900, (300, 64))
    simplex = simplex_kmeans.Simplex(simplex_kmeans.choose_pivots(points[:40]))
    low, high = simplex_kmeans.bounds(simplex.project(points), simplex.project(points[:20]))
    true = ((points[:, None] - points[None, :20]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()
