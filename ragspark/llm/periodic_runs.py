"""Runs of repeated words: maximal pairs at close distance, from the LCP-interval tree.

A run is a stretch of words with smallest period q, at least two periods long, that no neighbouring
word extends. Its beginning s and s + q start equal stretches that differ in the word before and in
the word behind: a maximal pair whose distance q is at most its length. Conversely such a pair
(i, j, n) spans exactly the run i .. j + n with a multiple of the run's period, so the pair of the
smallest distance gives the run, and nothing is left to extend.

The pairs come from the suffixes of a text in sorted order, merged bottom up along their LCP
intervals. Each interval keeps its places in order, and where the word before them changes (its
classes of left words). A smaller interval asks the larger one for the places within the length of
their common prefix and leaps over those with its own left word. Only prefixes of ``least / 2``
words or more can belong to a run of ``least`` words, so suffixes whose first words occur once are
left out before sorting, and intervals whose places lie further apart than their longest prefix
before merging.

Null and empty texts have no words and no runs; a null id is never rearranged. Equal rows give
equal results, an empty table an empty one, and other columns are not looked at. A text is worked on
as a whole, at about 60 bytes a word, since a run may span all of it; slices of texts bound the rest.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, mix, slices

#: Shortest run, in words.
LEAST = 12

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)),
                  ("collapsed", pa.string())])
FOUND = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
         "collapsed string")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the n + 1 bounds between the texts."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    kept = pc.not_equal(pc.binary_length(words), 0)
    counts = np.r_[0, np.cumsum(kept.to_numpy(zero_copy_only=False))]
    ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
    return words.filter(kept), counts[ends.astype(np.int64)]


class _Suffixes:
    """Suffixes that start with ``width`` words found elsewhere in their text, sorted, with the
    lengths of their common prefixes (0 where shorter than ``width``)."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, width: int):
        self.codes, self.ends, self.width = codes, ends, width
        self.order = self.lcp = np.zeros(0, np.int64)
        n = len(codes)
        starts = np.flatnonzero(np.arange(n) + width <= ends)
        key = ends[starts].astype(np.uint64)
        for j in range(width):
            key = key * _BASE + codes[starts + j].astype(np.uint64) + np.uint64(1)
        by_key = np.argsort(mix(key), kind="stable")
        key = key[by_key]
        same = key[1:] == key[:-1]
        again = starts[by_key[np.r_[False, same] | np.r_[same, False]]] if len(key) else starts
        if len(again):
            # to go on comparing behind a repeated stretch, its follower is ranked too
            marked = np.zeros(n + width, bool)
            marked[again] = True
            following = again + width
            marked[following[following < ends[again]]] = True
            self.places = np.flatnonzero(marked)
            self._sort()

    def _word(self, places: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return np.where(places < limit, self.codes[np.minimum(places, len(self.codes) - 1)], -1)

    def _rank(self, places: np.ndarray, limit: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        return np.where(places < limit, rank[at], -1)

    def _sort(self) -> None:
        """Prefix doubling: only suffixes that still share a rank are sorted again."""
        places, ends, width = self.places, self.ends[self.places], self.width
        keys = [ends, *(self._word(places + j, ends) for j in range(width))]
        order = np.lexsort(keys[::-1])
        fresh = np.zeros(len(order), bool)
        fresh[:1] = True
        for key in keys:
            fresh[1:] |= key[order[1:]] != key[order[:-1]]
        lcp = np.zeros(len(order), np.int64)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        levels, h = [], width
        while True:
            open_ = ~fresh | np.r_[~fresh[1:], False]
            at = np.flatnonzero(open_)
            if not len(at):
                break
            levels.append((h, rank.copy()))
            members = order[at]
            first, second = rank[members], self._rank(places[members] + h, ends[members], rank)
            by = np.lexsort((second, first))
            members, first, second = members[by], first[by], second[by]
            order[at] = members
            split = np.r_[False, (first[1:] == first[:-1]) & (second[1:] != second[:-1])]
            cut = at[split]
            fresh[cut] = True
            rank[members] = np.maximum.accumulate(np.where(fresh[at], at, 0))
            left, right = order[cut - 1], order[cut]
            lcp[cut] = self._common(places[left], places[right], ends[left], levels)
            h *= 2
        self.order, self.lcp = places[order], lcp

    def _common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, levels) -> np.ndarray:
        """Common prefix of suffixes known to agree on the last level's length but not on twice that."""
        length = np.full(len(a), levels[-1][0], np.int64)
        for h, rank in reversed(levels[:-1]):
            x, y = self._rank(a + length, limit, rank), self._rank(b + length, limit, rank)
            length += np.where((x == y) & (x >= 0), h, 0)
        going = np.ones(len(a), bool)
        for _ in range(self.width - 1):
            x, y = self._word(a + length, limit), self._word(b + length, limit)
            going &= (x == y) & (x >= 0)
            length += going
        return length


def _close_pairs(places: list[int], lcp: list[int], left: dict[int, int], out: list) -> None:
    """Maximal pairs (i, distance, length), distance at most length, of suffixes in sorted order;
    ``lcp[k]`` belongs to the suffixes k - 1 and k."""
    n = len(places)
    start_of, end_of = list(range(n)), list(range(n))  # of the interval that ends, or starts, here
    # an interval: its places in order, and those whose predecessor has another left word
    held = [([p], [p]) for p in places]
    for k in sorted(range(1, n), key=lambda k: -lcp[k]):
        length, s, e = lcp[k], start_of[k - 1], end_of[k]
        large, small = held[s], held[k]
        if len(large[0]) < len(small[0]):
            large, small = small, large
        held[k] = None
        held[s] = large
        start_of[e], end_of[s] = s, e
        inside, heads = large
        for p in small[0]:
            own, last = left[p], p + length
            i = bisect_left(inside, p - length)
            while i < len(inside) and inside[i] <= last:
                x = inside[i]
                if left[x] != own:
                    out.append((x, p - x, length) if x < p else (p, x - p, length))
                    i += 1
                    continue
                nxt = bisect_right(heads, x)  # leap over the class
                if nxt == len(heads):
                    break
                i = bisect_left(inside, heads[nxt])
        for p in small[0]:
            own, i = left[p], bisect_left(inside, p)
            if i == 0 or left[inside[i - 1]] != own:
                insort(heads, p)
            if i < len(inside):
                after = inside[i]
                at = bisect_left(heads, after)
                is_head = at < len(heads) and heads[at] == after
                if left[after] == own:
                    if is_head:
                        del heads[at]
                elif not is_head:
                    heads.insert(at, after)
            inside.insert(i, p)


def word_runs(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``codes``), length and period of all runs of the texts that ``bounds`` separate,
    ordered by start, then period."""
    nothing = np.zeros(0, np.int64)
    # a pair's length n and distance q make a run of n + q words, and q is at most n
    width = max(1, -(-least // 2))
    ends = np.repeat(bounds[1:], np.diff(bounds))
    suffixes = _Suffixes(codes, ends, width)
    order, lcp = suffixes.order, suffixes.lcp
    tree = np.cumsum(lcp == 0)  # suffixes that share their first words
    by_place = np.lexsort((order, tree))
    gap = np.full(len(order), np.iinfo(np.int64).max)
    near = np.diff(order[by_place])
    gap[1:][tree[by_place][1:] == tree[by_place][:-1]] = near[tree[by_place][1:] == tree[by_place][:-1]]
    firsts = np.flatnonzero(lcp == 0)
    if not len(firsts):
        return nothing, nothing, nothing
    close = np.minimum.reduceat(gap, firsts) <= np.maximum.reduceat(lcp, firsts)
    starts = set(bounds.tolist())
    found: list[tuple[int, int, int]] = []
    lasts = np.r_[firsts[1:], len(order)]
    for a, b in zip(firsts[close].tolist(), lasts[close].tolist()):
        places = order[a:b].tolist()
        before = codes[np.maximum(order[a:b] - 1, 0)].tolist()
        left = {p: -1 if p in starts else c for p, c in zip(places, before)}
        _close_pairs(places, lcp[a:b].tolist(), left, found)
    if not found:
        return nothing, nothing, nothing
    start, period, length = np.array(found, np.int64).T
    length = length + period
    long = length >= max(least, 1)
    start, period, length = start[long], period[long], length[long]
    by = np.lexsort((period, length, start))  # of one stretch the smallest period
    start, period, length = start[by], period[by], length[by]
    kept = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else long[:0]
    start, period, length = start[kept], period[kept], length[kept]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST,
              rearrange: Callable[[int, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every whole text.

    ``runs`` are ``start`` (word number from 0), ``length`` and smallest ``period`` of all runs of
    ``least`` words or more, by start, then period. ``collapsed`` is the text with single spaces and
    with every run cut to its first period. ``rearrange(doc_id, n)`` may return ``(a, p)``: each word
    i >= a of the n words is then taken to be word ``a + (i - a) % p``. Rows are independent; nothing
    is shuffled.
    """
    def run(batches):
        for piece in slices(batches):
            ids = piece.column("doc_id")
            words, bounds = split_words(piece.column("text"))
            where = np.arange(len(words))
            if rearrange is not None:
                for doc_id, a, b in zip(ids.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    change = rearrange(doc_id, b - a) if doc_id is not None and b > a else None
                    if change:
                        first, period = a + change[0], change[1]
                        where[first:b] = first + np.arange(b - first) % period
            codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)[where]
            start, length, period = word_runs(codes, bounds, least)
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, start + length, -1)
            kept = np.cumsum(drop[:-1]) == 0
            ends = np.r_[0, np.cumsum(kept)][bounds]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), words.take(pa.array(where[kept]))), " ")
            owner = np.searchsorted(start, bounds)
            shift = np.repeat(bounds[:-1], np.diff(owner))
            runs = pa.StructArray.from_arrays(
                [pa.array(start - shift, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())],
                fields=list(_RUN))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(bounds), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(owner, pa.int32()), runs), collapsed], schema=_OUT)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).alias("text")).mapInArrow(run, FOUND)


def periodic_tail(doc_id: int, n: int) -> tuple[int, int] | None:
    """The rearrangement of the registered query: one document in ten gets a periodic end."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run (of equal ones the first, then the shorter period) as
    ``start, length, period, exponent_milli``, and ``runs_sha256, collapsed_sha256``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    line = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.short")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
