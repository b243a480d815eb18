"""Substring dedup by MinHash banding over content-defined paragraphs.

Line breaks don't survive copying, so a text is cut into paragraphs by its own words: one begins at
each word whose hash is the smallest among its ``REACH`` neighbours on either side. A passage that
recurs in other surroundings falls into the same paragraphs but for its ends. Paragraphs of
``SHORTEST`` words or more are compared by their distinct shingles of five words.

1. Each paragraph has one band key for each of the bands that ``tune_bands`` asks for. One packed
   shuffle (``repeats``) drops the paragraphs whose keys occur nowhere else.
2. Equal paragraphs count as one from here on. Those that share a band key with up to ``FULL`` distinct
   paragraphs are compared each with each. All paragraphs of larger keys go through the token-group
   matrix of ``jaccard_join``, which finds every link among them without forming their pairs. Exact
   Jaccard similarity >= 0.75 makes a link.
3. Components of the links are clusters; in each the first occurrence (smallest id, then place)
   stays and the rest is marked for removal.

Null and empty texts have no paragraphs. Repeated rows are occurrences at the same place and are
reported once; rows of equal id and other text are told apart by content. Null ids come last.

A very long text is one numpy step of its own. Of occurrences that tie for the first place the
smaller place counts. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import sized
from .common import (_BASE, components, distinct, known_id, mix, pieces, public_id, signed, slices, stored, text_bytes,
                     words_of)
from .jaccard_join import MEMBERS, set_components
from .repeats import BUCKET_KEYS, PACKED, pack, settled

REACH, SHORTEST, WIDTH = 5, 8, 5
THRESHOLD, RECALL = 75, 0.999
#: Distinct paragraphs of a band key that are paired; those of larger keys meet in the matrix.
FULL = 32
_ITEMS = 60_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def tune_bands(percent: int = THRESHOLD, recall: float = RECALL, most_hashes: int = 64) -> tuple[int, int]:
    """``bands, rows`` with the fewest keys per paragraph that find a pair of this similarity with
    the wanted probability; among equals more rows, which collide less."""
    s, best = percent / 100, None
    for rows in range(1, most_hashes + 1):
        for bands in range(1, most_hashes // rows + 1):
            if 1 - (1 - s ** rows) ** bands >= recall and (best is None or bands < best[0]):
                best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


class Paragraphs:
    """Paragraphs of the texts of a slice: word places, shingles and contents."""

    def __init__(self, texts: pa.Array):
        words = words_of(texts)
        h, bounds, n = words.hashes, words.bounds, len(words.hashes)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        cut = np.ones(n, bool)
        for d in range(1, min(REACH, n - 1) + 1):
            same = row[d:] == row[:-d]
            less = h[:-d] < h[d:]
            cut[:-d] &= less | ~same
            cut[d:] &= (h[d:] < h[:-d]) | ~same
        starts = np.zeros(n, bool)
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        first = np.flatnonzero(cut | starts)
        size = np.diff(np.r_[first, n])
        kept = size >= SHORTEST
        self.text, self.size = row[first[kept]], size[kept]
        self.at = (first - bounds[row[first]])[kept] if n else first
        # shingles that lie within one kept paragraph
        counts = self.size - WIDTH + 1
        self.bounds = np.r_[0, np.cumsum(counts)].astype(np.int64)
        place = np.arange(self.bounds[-1]) + np.repeat(first[kept] - self.bounds[:-1], counts)
        run = np.zeros(len(place), np.uint64)
        for j in range(WIDTH):
            run = run * _BASE + h[place + j]
        self.shingles = mix(run)
        order = np.arange(len(place)) - np.repeat(self.bounds[:-1], counts)
        self.content = (np.add.reduceat(mix(self.shingles + order.astype(np.uint64) * _BASE), self.bounds[:-1])
                        if len(self.size) else np.zeros(0, np.uint64))

    def keys(self, bands: int, rows: int) -> np.ndarray:
        """Band keys, one row for each paragraph."""
        out = np.zeros((len(self.size), bands), np.uint64)
        for b in range(bands if len(self.size) else 0):
            for r in range(rows):
                seed = np.uint64(1 + b * rows + r) * _BASE
                out[:, b] = out[:, b] * _BASE + np.minimum.reduceat(mix(self.shingles ^ seed), self.bounds[:-1])
            out[:, b] = mix(out[:, b] + np.uint64(b))
        return out


def _packer(bands: int, rows: int, buckets: int):
    def run(batches):
        for piece in slices(batches):
            found = Paragraphs(piece.column("text"))
            ids, keys = piece.column("id").to_numpy()[found.text], found.keys(bands, rows)
            place = found.at.astype(np.int64) << 20 | np.minimum(found.size, (1 << 20) - 1)
            for a in range(0, len(ids), _ITEMS):
                z = slice(a, a + _ITEMS)
                own = keys[z]
                yield pack(own.reshape(-1), np.repeat(np.arange(len(own)), bands), np.full(len(own), bands),
                           ids[z], place[z], signed(found.content[z]), buckets)
    return run


_CONTENTS = "cid long, n int, shingles array<long>, keys array<long>"


def _reader(bands: int, rows: int):
    """Shingles and keys of the wanted paragraphs of each document."""
    def run(batches):
        for piece in slices(batches):
            found = Paragraphs(piece.column("text"))
            keys = found.keys(bands, rows)
            content = signed(found.content)
            wanted = piece.column("wanted").to_pylist()
            sets = [set(w) for w in wanted]
            take = [i for i, (t, c) in enumerate(zip(found.text.tolist(), content.tolist())) if c in sets[t]]
            shingles = [signed(distinct(np.sort(found.shingles[found.bounds[i]:found.bounds[i + 1]]))) for i in take]
            yield pa.RecordBatch.from_arrays(
                [pa.array(content[take], pa.int64()), pa.array([len(s) for s in shingles], pa.int32()),
                 pa.array(shingles, pa.list_(pa.int64())), pa.array(list(signed(keys)[take]), pa.list_(pa.int64()))],
                names=["cid", "n", "shingles", "keys"])
    return run


def _collisions(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs ``a < b`` of distinct paragraphs that share a band key of up to ``FULL`` of them, and the
    paragraphs ``cid`` of larger keys."""
    rows = stored(contents.select("cid", F.explode("keys").alias("key")), "passage-keys")
    sizes = rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    rows = rows.join(sizes, "key")
    small = rows.where(F.col("k") <= FULL).select("key", F.col("cid").alias("a"))
    pairs = small.join(small.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b").distinct()
    return pairs, rows.where(F.col("k") > FULL).select("cid").distinct()


def _members(batches):
    """Paragraphs as the sets of ``set_components``."""
    for batch in batches:
        column = batch.column("shingles")
        sets = [signed(np.asarray(column[i].values)) for i in range(len(column))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("cid"), batch.column("n"), pa.array([s[0] for s in sets], pa.int64()),
             pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "n", "least", "tokens"])


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      percent: int = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Paragraphs that occur more than once, exactly or nearly: ``doc_id, start_word, n_words,
    cluster_doc_id, cluster_start_word`` (the occurrence that stays) and ``removed``."""
    bands, rows = tune_bands(percent, recall)
    docs = docs.select(known_id(id_column).alias("id"), F.col(text_column).alias("text"))
    buckets = min(pieces(text_bytes(docs) * bands, 64 * BUCKET_KEYS), 32_000)
    items = settled(docs.mapInArrow(_packer(bands, rows, buckets), PACKED)).where("open")
    seen = stored(items.select(F.col("a").alias("id"), F.shiftright("b", 20).alias("at"),
                               F.col("b").bitwiseAND(F.lit((1 << 20) - 1)).alias("n"),
                               F.col("c").alias("cid")).distinct(), "passage-items")
    firsts = seen.groupBy("cid").agg(F.min("id").alias("id"))
    wanted = stored(firsts.groupBy("id").agg(F.collect_list("cid").alias("wanted")), "passage-wanted")
    size = wanted.agg(F.coalesce(F.sum(F.lit(32) + 8 * F.size("wanted")), F.lit(0)).alias("n")).first()["n"]
    read = docs.join(F.broadcast(wanted) if size <= 24 << 20 else wanted, "id").select("text", "wanted")
    contents = stored(read.mapInArrow(_reader(bands, rows), _CONTENTS).dropDuplicates(["cid"]), "passage-contents")
    pairs, crowd = _collisions(contents)
    sets = contents.select("cid", "n", "shingles")
    judged = (pairs.join(sets.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a")), "a")
              .join(sets.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b")), "b")
              .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
              .withColumn("k", F.size(F.array_intersect("s_a", "s_b")))
              .where(f"100 * k >= {percent} * (n_a + n_b - k)"))
    members = stored(contents.join(sized(stored(crowd, "passage-crowd"), ["cid"], 16 << 20), "cid").select("cid", "n", "shingles")
                     .mapInArrow(_members, MEMBERS), "passage-members")
    crowded = set_components(members, percent).select(F.col("sid").alias("a"), F.col("comp").alias("b"))
    found = components(judged.select("a", "b").unionByName(crowded))
    placed = (seen.join(found.withColumnRenamed("node", "cid"), "cid", "left")
              .select("id", "at", "n", F.coalesce("component", "cid").alias("cluster")))
    heads = (placed.groupBy("cluster").agg(F.count("*").alias("k"), F.min(F.struct("id", "at")).alias("first"))
             .where("k > 1").select("cluster", F.col("first.id").alias("head"), F.col("first.at").alias("head_at")))
    return placed.join(heads, "cluster").select(
        public_id("id").alias("doc_id"), F.col("at").alias("start_word"), F.col("n").alias("n_words"),
        public_id("head").alias("cluster_doc_id"), F.col("head_at").alias("cluster_start_word"),
        ((F.col("id") != F.col("head")) | (F.col("at") != F.col("head_at"))).alias("removed"))
