"""Helpers of this subpackage: text slices inside a task, word hashes, sizes, connected components."""

from __future__ import annotations

import ctypes
import gc
import resource
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, fresh_path

#: Text bytes that one numpy step works on; a longer single text is a step of its own.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 8_000
#: A worker above this gives memory back after each group.
FRUGAL_BYTES = 240 << 20
#: Stands for a null id inside an operator, so that a real id is always the smaller one.
NO_ID = (1 << 63) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    def made(size: int, base: np.uint64) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    size = SLICE_BYTES + 1024
    if n > size:  # of a single long text; not kept
        return made(n, _BASE), made(n, _INVERSE)
    if not _powers:
        _powers.update(up=made(size, _BASE), down=made(size, _INVERSE))
    return _powers["up"][:n], _powers["down"][:n]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES,
           rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``size`` bytes in each piece."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + size, side="right"))
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 bounds between them; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


class Words(NamedTuple):
    """Words of several texts in reading order."""
    hashes: np.ndarray   # 64-bit, of the lower-cased bytes
    bounds: np.ndarray   # words of text i lie between bounds[i] and bounds[i + 1]
    starts: np.ndarray   # byte positions within the slice
    ends: np.ndarray
    data: np.ndarray     # lower-cased bytes of the slice
    spans: np.ndarray    # byte bounds of the texts


def words_of(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, hashed by a rolling sum."""
    data, spans = raw_bytes(texts)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[spans] = True
    before = np.r_[False, inside[:-1]] if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.r_[inside[1:], False] if len(data) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    hashes = range_hashes(data, starts, ends)
    return Words(hashes, np.searchsorted(starts, spans), starts, ends, data, spans)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 sums: np.ndarray | None = None) -> np.ndarray:
    """Hashes of byte ranges, equal for equal bytes wherever they stand."""
    sums = prefix_sums(data) if sums is None else sums
    _, down = powers(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles_of(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and their bounds by text.

    A text with fewer words, but at least one, has the whole sequence as its only shingle.
    """
    w, bounds = words.hashes, words.bounds
    counts = np.diff(bounds)
    runs = np.maximum(counts - width + 1, 0)
    out = np.zeros(max(len(w) - width + 1, 0), np.uint64)
    for j in range(width if len(out) else 0):
        out = out * _BASE + w[j:j + len(out)]
    out = mix(out)
    row = np.repeat(np.arange(len(counts)), runs)
    offset = np.cumsum(runs) - runs
    hashes = out[bounds[:-1][row] + np.arange(len(row)) - offset[row]] if len(row) else out[:0]
    sizes = np.where(counts >= width, runs, (counts > 0).astype(np.int64))
    ends = np.cumsum(sizes)
    total = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    long = np.repeat(counts >= width, sizes)
    total[long] = hashes
    for c in range(1, width):
        texts = np.flatnonzero(counts == c)
        h = np.full(len(texts), c, np.uint64)
        for j in range(c):
            h = h * _BASE + w[bounds[texts] + j]
        total[ends[texts] - 1] = mix(h + np.uint64(c))
    return total, np.r_[0, ends].astype(np.int64)


def distinct(sorted_values: np.ndarray) -> np.ndarray:
    if len(sorted_values) < 2:
        return sorted_values
    return sorted_values[np.r_[True, sorted_values[1:] != sorted_values[:-1]]]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits or idles does not keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only where the C library has it
        pass


def _resident() -> int:
    """Bytes this process holds; 0 where the system does not say."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()
    except OSError:
        return 0


def frugal_group(run):
    """``run`` over one group, with memory given back when the worker has come to hold much."""
    def wrapped(group):
        out = run(group)
        if _resident() > FRUGAL_BYTES:
            give_back()
        return out
    return wrapped


def frugal_cogroup(run):
    def wrapped(left, right):
        out = run(left, right)
        if _resident() > FRUGAL_BYTES:
            give_back()
        return out
    return wrapped


def frugal(run):
    """``run`` over the batches of a task, after which the worker gives its memory back."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def source(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, counted over all rows; sizes buckets and blocks."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0)).alias("n")).first()["n"]


def pieces(total: int, each: int) -> int:
    return max(1, -(-int(total) // each))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: several branches use it,
    and a lost executor must not lead to a second computation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as keep it off the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def known_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def public_id(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest reachable node) of the links ``a, b``.

    Rounds of large stars and small stars: each takes two aggregations and two joins whose
    size follows the links, and the number of rounds the logarithm of the longest chain.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .where("a <> b").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = (e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b"))
        e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if now == mark:
            break
        mark = now
    return (e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
