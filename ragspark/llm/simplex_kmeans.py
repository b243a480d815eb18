"""Clusters around centroids in whole numbers, with centroids filtered by an n-simplex projection.

The distances from a vector to a few pivots, taken once, place it as the apex of a simplex over the
pivots: coordinates along the pivots' base and its height above it. From two apexes follow a lower
bound of the Euclidean distance of their vectors (both heights on one side) and an upper bound (on
opposite sides). The apexes of all vectors are stored beside them; in each round the centroids are
projected too, those whose lower bound exceeds the least upper bound of a vector are put aside, and
only the others are compared exactly, in whole numbers.

The bounds are the closer the nearer the centroids lie to the pivots' base. So the pivots are the
first centroids and those that a bounded sample of ``SAMPLE`` vectors (smallest hashes) arrives at,
farthest first, as long as each stands off the base of those before. Rounding is met by a margin, so
the filter never decides: it only saves comparisons. On vectors without any clusters it saves few.

Kept are vectors of ``dims`` components, none null or non-finite. Components up to 2**27 in whole
numbers are packed in 32 bits; the rare vector beyond takes part in exact integers of any size, without
filter, and a distance or sum above 2**63 - 1 is given as that number. Repeated rows count each; equal
hashes (repeated ids) are ordered by the vectors. A null id counts as the text ``null``. Fewer vectors
than ``k`` make as many clusters; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

K, ROUNDS, DIMS, SCALE = 8, 10, 64, 1024
PIVOTS = 16
SAMPLE = 2048
#: Whole numbers up to this have distances and products that 64 bits hold.
PACKED = 1 << 27
LIMB = 48
MOST = (1 << 63) - 1
#: Share of the scale that a pivot must stand off the base of the others.
LEAST_HEIGHT = 0.02
#: Largest condition number of the base; beyond it the last pivots are left out.
CONDITION = 1e5
MARGIN = 1e-6


def _whole(vector: list[float], scale: int = SCALE) -> list[int]:
    """floor(scale * x), exact for every finite double."""
    out = []
    for x in vector:
        top, bottom = float(x).as_integer_ratio()
        out.append(top * scale // bottom)
    return out


class Simplex:
    """Apex coordinates from squared distances to pivots."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(np.float64)
        m = len(pivots)
        self.base = np.zeros((m, m))
        for i in range(1, m):  # each pivot is the apex over those before
            gap = ((self.pivots[:i] - self.pivots[i]) ** 2).sum(axis=1)
            self.base[i, :i] = self._apex(gap[None], i)[0]
        self.solve = np.linalg.inv(self.base[1:, :m - 1]).T if m > 1 else np.zeros((0, 0))
        self.square = (self.base ** 2).sum(axis=1)

    def _apex(self, square: np.ndarray, m: int) -> np.ndarray:
        """Coordinates over the first ``m`` pivots: m - 1 along their base, then the height."""
        base = self.base[1:m, :m - 1]
        side = (square[:, :1] - square[:, 1:m] + (base ** 2).sum(axis=1)) / 2
        along = side @ np.linalg.inv(base).T if m > 1 else side
        height = np.sqrt(np.maximum(square[:, 0] - (along ** 2).sum(axis=1), 0))
        return np.concatenate([along, height[:, None]], axis=1)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        square = (v * v).sum(axis=1)[:, None] + (self.pivots ** 2).sum(axis=1) - 2 * v @ self.pivots.T
        return self._apex(np.maximum(square, 0), len(self.pivots))


def choose_pivots(candidates: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Farthest from the base first; at least one."""
    chosen = [0]
    scale = np.sqrt(((candidates - candidates[0]).astype(np.float64) ** 2).sum(axis=1).max())
    while len(chosen) < most and scale:
        height = Simplex(candidates[chosen]).project(candidates)[:, -1]
        height[chosen] = 0
        best = int(height.argmax())
        if height[best] <= LEAST_HEIGHT * scale:
            break
        chosen.append(best)
        if np.linalg.cond(Simplex(candidates[chosen]).base[1:, :-1]) > CONDITION:
            chosen.pop()
            break
    return candidates[chosen]


def sample_centres(sample: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Where the centroids of a sample come to lie; a choice of pivots needs no exactness."""
    for _ in range(rounds if len(sample) else 0):
        wide = centres.astype(np.float64)
        which = ((wide ** 2).sum(axis=1) - 2 * sample.astype(np.float64) @ wide.T).argmin(axis=1)
        centres = np.array([sample[which == j].sum(axis=0) // (which == j).sum() if (which == j).any() else c
                            for j, c in enumerate(centres)])
    return centres


def bounds(apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, with a margin for rounding."""
    square = (apexes ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1)
    low = square - 2 * apexes @ centres.T
    high = low + 4 * apexes[:, -1:] * centres[:, -1]
    return low - MARGIN * square - 0.5, high + MARGIN * square + 0.5


def nearest(vectors: np.ndarray, apexes: np.ndarray, centres: np.ndarray, simplex: Simplex
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (of equal ones the smaller number), squared distance, and how many centroids
    were compared exactly."""
    low, high = bounds(apexes, simplex.project(centres))
    open_ = low <= high.min(axis=1)[:, None]
    best = np.full(len(vectors), MOST, np.int64)
    which = np.zeros(len(vectors), np.int64)
    for j in range(len(centres)):
        rows = np.flatnonzero(open_[:, j])
        gap = vectors[rows].astype(np.int64) - centres[j]
        square = np.einsum("ij,ij->i", gap, gap)
        closer = square < best[rows]
        best[rows[closer]], which[rows[closer]] = square[closer], j
    return which, best, open_.sum(axis=1)


def _nearest_wide(vector: list[int], centres: list[list[int]]) -> tuple[int, int]:
    return min((sum((x - c) ** 2 for x, c in zip(vector, centre)), j) for j, centre in enumerate(centres))[::-1]


def _matrix(batch: pa.RecordBatch, name: str, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, width)


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                  dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, packed, wide`` of the kept vectors: 32-bit whole numbers, or the doubles of a vector
    that has larger ones."""
    fine = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = (vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
            .where((F.size("v") == dims) & fine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("v").flatten().to_numpy().reshape(-1, dims)
            fits = np.abs(raw).max(axis=1, initial=0) * scale <= PACKED - 1
            whole = np.floor(np.where(fits[:, None], raw, 0) * scale).astype(np.int32)
            packed = [w.tobytes() if f else None for w, f in zip(whole, fits)]
            wide = [None if f else r.tolist() for r, f in zip(raw, fits)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(packed, pa.binary()), pa.array(wide, pa.list_(pa.float64()))],
                names=["vec_id", "packed", "wide"])
    return rows.mapInArrow(run, "vec_id long, packed binary, wide array<double>")


def _hashed(salt: str):
    return F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)


def _smallest(whole: DataFrame, salt: str, n: int, scale: int) -> list[list[int]]:
    """Whole numbers of the ``n`` vectors with the smallest hashes; ``n`` is a small constant."""
    rows = whole.orderBy(_hashed(salt), "packed", "wide").limit(n).select("packed", "wide").collect()
    return [np.frombuffer(r["packed"], np.int32).tolist() if r["wide"] is None else _whole(r["wide"], scale)
            for r in rows]


def _projected(whole: DataFrame, pivots: np.ndarray) -> DataFrame:
    def run(batches):
        simplex = Simplex(pivots) if len(pivots) else None
        for batch in batches:
            apex = [None] * batch.num_rows
            rows = batch.column("packed").is_valid().to_numpy(zero_copy_only=False)
            if rows.any():
                found = simplex.project(_matrix(batch.filter(pa.array(rows)), "packed", np.int32, pivots.shape[1]))
                for i, a in zip(np.flatnonzero(rows).tolist(), found):
                    apex[i] = a.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(apex, pa.binary())],
                                             names=["vec_id", "packed", "wide", "apex"])
    return whole.mapInArrow(run, "vec_id long, packed binary, wide array<double>, apex binary")


def _assigned(batches, centres: list[list[int]], pivots: np.ndarray, dims: int, scale: int):
    """Batches with ``packed`` and ``apex``: (batch, vectors, which, square, compared) and wide rows."""
    fits = all(abs(x) <= PACKED for c in centres for x in c)
    simplex = Simplex(pivots) if len(pivots) else None
    for batch in batches:
        easy = batch.column("packed").is_valid().to_numpy(zero_copy_only=False) & fits
        part = batch.filter(pa.array(easy))
        if part.num_rows:
            vectors = _matrix(part, "packed", np.int32, dims)
            apexes = _matrix(part, "apex", np.float64, len(pivots))
            found = nearest(vectors, apexes, np.array(centres, np.int64), simplex)
            yield part, vectors, *found
        for row in batch.filter(pa.array(~easy)).to_pylist():
            vector = _whole(row["wide"], scale) if row["packed"] is None else np.frombuffer(row["packed"], np.int32).tolist()
            which, square = _nearest_wide(vector, centres)
            yield row["vec_id"], vector, which, square, len(centres)


def _sums(cached: DataFrame, centres, pivots, dims: int, scale: int) -> tuple[list[int], list[list[int]]]:
    """Rows and exact component sums of each cluster: one row per task, cluster and component, merged
    by an aggregation into ``k * dims`` rows."""
    def run(batches):
        k = len(centres)
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        wide: dict[tuple[int, int, int], int] = {}
        for first, vectors, which, _, _ in _assigned(batches, centres, pivots, dims, scale):
            if isinstance(first, pa.RecordBatch):
                for j in range(k):
                    mine = which == j
                    total[j] += vectors[mine].sum(axis=0, dtype=np.int64)
                    count[j] += int(mine.sum())
                continue
            count[which] += 1
            for d, x in enumerate(vectors):
                limb = 0
                while x not in (0, -1):
                    wide[which, d, limb] = wide.get((which, d, limb), 0) + x % (1 << LIMB)
                    x, limb = x >> LIMB, limb + 1
                if x:
                    wide[which, d, limb] = wide.get((which, d, limb), 0) - 1
        rows = [(j, d, 0, x) for j in range(k) for d, x in enumerate(total[j].tolist()) if x]
        rows += [(j, -1, 0, c) for j, c in enumerate(count.tolist()) if c]
        rows += [(*key, x) for key, x in wide.items()]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["cluster", "dim", "limb", "total"])

    merged = (cached.select("vec_id", "packed", "wide", "apex")
              .mapInArrow(run, "cluster int, dim int, limb int, total long")
              .groupBy("cluster", "dim", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    counts = [0] * len(centres)
    sums = [[0] * dims for _ in centres]
    for r in merged:
        if r["dim"] < 0:
            counts[r["cluster"]] = int(r["total"])
        else:
            sums[r["cluster"]][r["dim"]] += int(r["total"]) << (LIMB * r["limb"])
    return counts, sums


def clusters(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K,
             rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, pivots: int = PIVOTS,
             salt: str = "3:") -> tuple[DataFrame, list[list[int]]]:
    """Assignment ``vec_id, cluster, distance, compared`` of every kept vector after ``rounds`` rounds,
    and the final centroids. ``distance`` is squared; ``compared`` counts the centroids that the
    bounds left for the exact comparison.

    The first ``k`` centroids are the vectors with the smallest sha256 of ``salt`` and id. Each
    round reads the stored vectors once and brings back ``k * dims`` sums.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, id_column, vector_column, dims, scale)
    centres = _smallest(whole, salt, k, scale)
    out = "vec_id long, cluster int, distance long, compared int"
    if not centres:
        return spark.createDataFrame([], out), []
    sample, first = (np.array([v for v in part if all(abs(x) < PACKED for x in v)], np.int64).reshape(-1, dims)
                     for part in (_smallest(whole, "pivot:" + salt, SAMPLE, scale), centres))
    base = np.zeros((1, dims), np.int64)
    if len(first):
        base = choose_pivots(np.concatenate([first, sample_centres(sample, first, rounds)]), pivots)
    cached = stored(_projected(whole, base), "simplex-vectors")
    for _ in range(rounds):
        counts, sums = _sums(cached, centres, base, dims, scale)
        moved = [[s // n for s in row] if n else old for n, row, old in zip(counts, sums, centres)]
        if moved == centres:
            break  # the rounds left would change nothing
        centres = moved

    def run(batches):
        for first, _, which, square, compared in _assigned(batches, centres, base, dims, scale):
            if isinstance(first, pa.RecordBatch):
                columns = [first.column("vec_id"), pa.array(which, pa.int32()), pa.array(square, pa.int64()),
                           pa.array(compared, pa.int32())]
            else:
                columns = [pa.array([first], pa.int64()), pa.array([which], pa.int32()),
                           pa.array([min(square, MOST)], pa.int64()), pa.array([compared], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "compared"])
    return cached.mapInArrow(run, out), centres


def centroid_clusters(vectors: DataFrame, **how) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared``."""
    assigned, centres = clusters(vectors, **how)
    if centres:
        assigned = stored(assigned, "simplex-assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    told = [(j, min(s, MOST), min(sum(sums.values()), MOST),
             hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for j, s in sums.items()]
    per_cluster = vectors.sparkSession.createDataFrame(
        told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")
