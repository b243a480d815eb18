"""Which items hold a key that occurs anywhere else: one packed shuffle of key hashes.

A slice of texts sends each bucket of the key space one sorted array, eight bytes a key (48 hash
bits and the item's number in the slice; the bucket adds further bits). A key that several items
of a slice hold is sent once and marked, so a frequent key is one entry per slice. The bucket
answers with the item numbers whose key others hold too. A hash collision can only keep an item
too many, which the exact steps after this one then settle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal_group

#: Item number of a key that several items of the slice hold.
SHARED = 0xFFFF
#: Keys of one bucket: 8 MB of entries.
BUCKET_KEYS = 1 << 20
PACKED = ("slice long, bucket int, entries binary, need array<int>, single array<int>, "
          "a array<long>, b array<long>, c array<long>")
_TYPES = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("entries", pa.binary()),
                    ("need", pa.list_(pa.int32())), ("single", pa.list_(pa.int32())),
                    ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("c", pa.list_(pa.int64()))])
_LOW = np.uint64(0xFFFF)


def pack(keys: np.ndarray, item: np.ndarray, need: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray,
         buckets: int) -> pa.RecordBatch:
    """One slice: ``keys`` (64-bit, distinct per item) with their ``item`` numbers, below 65,535.

    An item whose keys occur nowhere else ``need`` times or more needs no further look.
    """
    bucket = ((keys & _LOW) >> np.uint64(1)).astype(np.int64) % buckets
    entry = (keys & ~_LOW) | item.astype(np.uint64)
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    entry, bucket = entry[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    single = np.zeros(len(need), np.int64)
    rows: list[tuple[int, bytes]] = []
    for k in range(buckets):
        part = np.sort(entry[cuts[k]:cuts[k + 1]])
        if not len(part):
            continue
        key = part & ~_LOW
        again = np.r_[False, key[1:] == key[:-1]]
        shared = again | np.r_[again[1:], False]
        part = np.where(shared, part | _LOW, part)[~again]
        own = (part & _LOW).astype(np.int64)
        single += np.bincount(own[own != SHARED], minlength=len(need))
        rows.append((k, part.tobytes()))
    # the same rows make the same name; slices of equal rows may share one
    mark = int.from_bytes(hashlib.blake2b(a.tobytes() + b.tobytes() + c.tobytes(), digest_size=8).digest(),
                          "big", signed=True)
    n = len(rows)
    lists = lambda x, kind: pa.array([None] * n + [x], pa.list_(kind))
    return pa.RecordBatch.from_arrays([
        pa.array([mark] * (n + 1), pa.int64()), pa.array([k for k, _ in rows] + [mark % buckets], pa.int32()),
        pa.array([x for _, x in rows] + [None], pa.binary()), lists(need, pa.int32()), lists(single, pa.int32()),
        lists(a, pa.int64()), lists(b, pa.int64()), lists(c, pa.int64())], schema=_TYPES)


def _answer(group: pa.Table) -> pa.Table:
    known = group.filter(group.column("entries").is_valid())
    parts = [np.frombuffer(x, np.uint64) for x in known.column("entries").to_pylist()]
    if parts:
        entry = np.concatenate(parts)
        _, inverse, count = np.unique(entry & ~_LOW, return_inverse=True, return_counts=True)
        item = (entry & _LOW).astype(np.uint16)
        hit = (count[inverse] > 1) & (item != SHARED)
        ends = np.cumsum([len(p) for p in parts])
        answers = [item[a:b][hit[a:b]].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends)]
        known = known.set_column(2, "entries", pa.array(answers, pa.binary()))
    rest = group.filter(group.column("entries").is_null())
    return pa.concat_tables([known.cast(_TYPES), rest.cast(_TYPES)])


_SETTLED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("open", pa.bool_())])


def _settle(group: pa.Table) -> pa.Table:
    replies = [np.frombuffer(x, np.uint16) for x in group.column("entries").to_pylist() if x]
    found = np.concatenate(replies).astype(np.int64) if replies else np.zeros(0, np.int64)
    out = []
    for row in group.filter(group.column("entries").is_null()).select(["need", "single", "a", "b", "c"]).to_pylist():
        need = np.array(row["need"], np.int64)
        alone = np.array(row["single"], np.int64) - np.bincount(found, minlength=len(need))
        out.append(pa.table([pa.array(row[x], pa.int64()) for x in "abc"] + [pa.array(alone < need)], schema=_SETTLED))
    return pa.concat_tables(out) if out else _SETTLED.empty_table()


def settled(packed: DataFrame) -> DataFrame:
    """``a, b, c, open`` of every item; an item that is not open shares too few keys with others."""
    answers = packed.groupBy("bucket").applyInArrow(frugal_group(_answer), PACKED)
    return answers.groupBy("slice").applyInArrow(frugal_group(_settle), "a long, b long, c long, open boolean")
