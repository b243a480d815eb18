"""Document fingerprints from closed syncmers.

A k-mer of code points is kept when the smallest hash of its inner s-mers lies at its first or
last place. The choice depends on nothing outside the k-mer, so a passage keeps its anchors when
the text around it changes. ``anchors`` returns them with positions; a fingerprint is the sorted
list of the smallest anchor hashes, and the likeness of two fingerprints the Jaccard estimate from
the smallest hashes of their union.

Null and empty texts have the empty fingerprint: like each other (1.0), unlike all others (0.0). A
text without any syncmer, such as one shorter than k, has its whole content as one anchor. Equal
texts, also repeated rows, have equal fingerprints.

A very long text is one numpy step of its own, at about 40 bytes a code point. Equal hashes within a
text count once, so ties need no rule. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, mix, pieces, signed, slices, text_bytes

K, S = 24, 8
SIZE = 96
#: Code points that one numpy step works on.
STEP_CHARS = 1 << 18
#: Text bytes of one range of ids, and the most ranges: beyond, a range grows, which its task streams.
RANGE_BYTES = 24 << 20
MOST_RANGES = 20_000


def _chosen(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of all closed syncmers of the texts laid out in ``codes``."""
    n = len(codes)
    if n < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner = np.zeros(n - S + 1, np.uint64)
    for j in range(S):
        inner = inner * _BASE + codes[j:j + len(inner)]
    inner = mix(inner)
    width, least, span = K - S + 1, inner, 1
    while span < width:  # minimum over a window that doubles until it fits
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    count = n - K + 1
    kept = (inner[:count] == least[:count]) | (inner[width - 1:width - 1 + count] == least[:count])
    at = np.flatnonzero(kept)
    text = np.searchsorted(bounds, at, side="right")
    at = at[at + K <= bounds[np.minimum(text, len(bounds) - 1)]]
    step = S  # K is a multiple of S: the hash of a k-mer joins those of its blocks
    value = np.zeros(len(at), np.uint64)
    for j in range(0, K, step):
        value = value * _BASE + inner[at + j]
    return at, mix(value)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _whole(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "big")


def sketches(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """For each text the ``size`` smallest distinct 32-bit anchor hashes, sorted."""
    out: list[np.ndarray] = []
    first = 0
    while first < len(texts):
        last, chars = first + 1, len(texts[first])
        while last < len(texts) and chars + len(texts[last]) <= STEP_CHARS:
            chars += len(texts[last])
            last += 1
        part = texts[first:last]
        codes, bounds = _codes(part)
        at, value = _chosen(codes, bounds)
        owner = np.searchsorted(bounds, at, side="right") - 1
        key = np.sort((owner.astype(np.uint64) << np.uint64(32)) | (value >> np.uint64(32)))
        if len(key):
            key = key[np.r_[True, key[1:] != key[:-1]]]
        ends = np.searchsorted(key, np.arange(len(part) + 1, dtype=np.uint64) << np.uint64(32))
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for i, text in enumerate(part):
            found = low[ends[i]:min(ends[i + 1], ends[i] + size)]
            if not len(found) and text:
                found = np.array([_whole(text)], np.uint32)
            out.append(found)
        first = last
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    again = both[1:] == both[:-1]
    fresh = np.r_[True, ~again]
    limit = min(size, int(fresh.sum()))
    if len(a) < size and len(b) < size:
        limit = int(fresh.sum())
    rank = np.cumsum(fresh)
    return float((again & (rank[1:] <= limit)).sum() / limit)


def fingerprint(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def anchors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, position, hash`` of every closed syncmer, positions in code points."""
    def run(batches):
        for piece in slices(batches):
            ids = piece.column("doc_id")
            codes, bounds = _codes([t or "" for t in piece.column("text").to_pylist()])
            at, value = _chosen(codes, bounds)
            owner = np.searchsorted(bounds, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner)), pa.array(at - bounds[owner]), pa.array(signed(value))],
                names=["doc_id", "position", "hash"])
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        run, "doc_id long, position long, hash long")


def _edited(text: str, following: str) -> str:
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                  ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _dealer(bounds: np.ndarray):
    """Texts by range of ids, packed; one sort key for equal ids."""
    def run(batches):
        press = zstandard.ZstdCompressor(1)
        for piece in slices(batches):
            ids = piece.column("id").to_numpy()
            raw = [(t or "").encode() for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(bounds, ids, side="left").astype(np.int32)), piece.column("id"),
                 piece.column("doc_id"), pa.array([hashlib.sha256(r).digest()[:12] for r in raw], pa.binary()),
                 pa.array([press.compress(r) for r in raw], pa.binary())],
                names=["part", "id", "doc_id", "tie", "packed"])
    return run


def _greatest(bounds: np.ndarray):
    """The greatest id of each range, once for each task."""
    def run(batches):
        found: dict[int, int] = {}
        for batch in batches:
            ids = np.sort(batch.column(0).to_numpy())
            part = np.searchsorted(bounds, ids, side="left")
            last = np.flatnonzero(np.r_[part[1:] != part[:-1], True]) if len(ids) else part
            for p, i in zip(part[last].tolist(), ids[last].tolist()):
                found[p] = max(i, found.get(p, i))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
                                         names=["part", "id"])
    return run


def _pairs(batches):
    """Rows come by part, then guests last, then descending; each is followed by its next."""
    unpress = zstandard.ZstdDecompressor()
    part = last = None
    rows: list[tuple] = []

    def told(rows):
        texts = [r[1] for r in rows] + [r[3] for r in rows] + [r[2] for r in rows]
        n, found = len(rows), sketches(texts)
        own, edited, following = found[:n], found[n:2 * n], found[2 * n:]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(r[3].encode()).hexdigest() for r in rows]),
            pa.array([fingerprint(x) for x in own]), pa.array([fingerprint(x) for x in edited]),
            pa.array([likeness(x, y) for x, y in zip(own, edited)], pa.float64()),
            pa.array([likeness(x, y) for x, y in zip(own, following)], pa.float64())], schema=_OUT)

    chars = 0
    for batch in batches:
        for p, guest, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "packed"))):
            if p == part and last is None:
                continue  # a second guest
            text = unpress.decompress(packed).decode()
            if p == part:
                rows.append((last[0], last[1], text, _edited(last[1], text)))
                chars += 3 * len(last[1])
            part, last = p, None if guest else (doc_id, text)
            if chars > 4 * STEP_CHARS:
                yield told(rows)
                rows, chars = [], 0
    if rows:
        yield told(rows)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, in which the last third is replaced by the
    beginning of the next document (descending id; the first follows the last).

    Null ids come last; rows with equal ids are ordered by a digest of their text. The texts are
    shuffled once, by ranges of ids; the document that follows a range visits it as a guest.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    parts = min(pieces(text_bytes(docs), RANGE_BYTES), MOST_RANGES)
    cuts = docs.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.unique(np.array(cuts, np.float64)).astype(np.int64)
    tops = (docs.select("id").mapInArrow(_greatest(bounds), "part int, id long")
            .groupBy("part").agg(F.max("id").alias("id")).orderBy("part").collect())  # one row for each range
    host = {row["part"]: tops[i + 1 if i + 1 < len(tops) else 0]["part"] for i, row in enumerate(tops)}
    spark = docs.sparkSession
    ends = spark.createDataFrame([(r["part"], host[r["part"]], r["id"]) for r in tops], "part int, host int, id long")
    # of rows with the greatest id of a range, the one that comes first there
    digest = F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 24))
    guests = (docs.join(F.broadcast(ends), "id").groupBy("part", "host", "id").agg(F.max(digest).alias("tie")))
    dealt = docs.mapInArrow(_dealer(bounds), "part int, id long, doc_id long, tie binary, packed binary")
    marked = dealt.join(F.broadcast(guests), ["part", "id", "tie"], "left").select(
        F.explode(F.when(F.col("host").isNull(), F.array(F.struct("part", F.lit(0).alias("guest"))))
                  .otherwise(F.array(F.struct("part", F.lit(0).alias("guest")),
                                     F.struct(F.col("host").alias("part"), F.lit(1).alias("guest"))))).alias("at"),
        "id", "doc_id", "tie", "packed").select("at.*", "id", "doc_id", "tie", "packed")
    laid = (marked.repartitionById(len(bounds) + 1, F.col("part"))
            .sortWithinPartitions("part", "guest", F.desc("id"), F.desc("tie")))
    return laid.select("part", "guest", "doc_id", "packed").mapInArrow(_pairs, (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"))
