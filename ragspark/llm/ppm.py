"""Prediction by partial matching: log10 probabilities of texts under a byte-context trie.

The trie holds, for every context of up to ``ORDER`` bytes, the bytes (or the end of the text) that
followed it in the training documents. A byte is coded at its longest known context; where it was
never seen there, an escape (method D: half of the distinct symbols over the occurrences) leads to
the next shorter context, in which the symbols of the longer one are excluded. Shorter contexts of
two bytes or more count a symbol once for each longer context it was seen in. Below the empty
context all remaining of 257 symbols are equally likely.

The trie is never in one place. Blocks of documents send their distinct (context, byte) pairs with
training counts to buckets by the last two bytes of the context, so a bucket holds every longer
context of these and derives all orders from the longest; only the orders 1 and 0 (65,792 counters
at most, whatever the corpus holds) are broadcast. A bucket answers with one log probability for
each pair, and blocks add them up. Word counts of the base score travel the same way.

The model is pretrained on all documents that are not held out. Null texts count as empty: one end
symbol. A null id is not held out. Repeated rows teach and score each on their own.

A very long text is read in one step of its block. Scores depend on counts alone, so there are no ties to
break. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct, pieces, slices, stored, text_bytes, words_of

ORDER = 5
SYMBOLS = 257
#: Text bytes of one block, and of one numpy step in it.
BLOCK_BYTES, STEP_BYTES = 8 << 20, 1 << 20
_NINE, _EIGHT = np.uint64(9), np.uint64(8)


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _squeeze(x: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, compressed."""
    step = np.diff(x, prepend=x.dtype.type(0)) if x.dtype == np.uint64 else x
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def _spread(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(kind.itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return np.cumsum(x, dtype=np.uint64) if kind == np.uint64 else x


def _steps(texts: list[bytes]):
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= STEP_BYTES:
            size += len(texts[last])
            last += 1
        yield first, last
        first = last


def pairs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context of ``ORDER`` bytes, symbol) of every place of the texts, and bounds by text."""
    pad = b"\0" * ORDER
    data = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8).astype(np.uint64)
    ends = np.cumsum([len(t) + ORDER + 1 for t in texts])
    context = np.zeros(len(data), np.uint64)
    for j in range(ORDER):
        context[ORDER:] = (context[ORDER:] << _EIGHT) | data[j:len(data) - ORDER + j]
    symbol = data.copy()
    symbol[ends - 1] = 256
    real = np.ones(len(data), bool)
    starts = ends - np.array([len(t) + ORDER + 1 for t in texts])
    for j in range(ORDER):
        real[starts + j] = False
    keys = ((context << _NINE) | symbol)[real]
    return keys, np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often they occur where ``learn``."""
    taught, n = np.unique(keys[learn], return_counts=True)
    rest = distinct(np.sort(keys[~learn]))
    return _merge([(taught, n.astype(np.int64)), (rest, np.zeros(len(rest), np.int64))])


def _bucket(keys: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    if kind == 0:  # by the last two bytes of the context
        keys = ((keys >> _NINE) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B1)
        keys = keys ^ (keys >> np.uint64(15))
    return (keys % np.uint64(buckets)).astype(np.int64)


_ASK = "block int, kind int, bucket int, keys binary, counts binary"


def _asker(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        texts, held = _unpacked(group), group.column("held").to_numpy(zero_copy_only=False)
        found: list[list] = [[], []]
        for first, last in _steps(texts):
            keys, bounds = pairs_of(texts[first:last])
            learn = np.repeat(~held[first:last], np.diff(bounds))
            found[0].append(_counted(keys, learn))
            words = words_of(pa.array(texts[first:last], pa.binary()).cast(pa.large_binary()))
            found[1].append(_counted(words.hashes, np.repeat(~held[first:last], np.diff(words.bounds))))
            for kind in (0, 1):
                if len(found[kind]) > 4:
                    found[kind] = [_merge(found[kind])]
        rows = []
        for kind in (0, 1):
            keys, counts = _merge(found[kind])
            bucket = _bucket(keys, kind, buckets)
            for b in np.unique(bucket):
                here = bucket == b
                rows.append((kind, int(b), _squeeze(keys[here]), _squeeze(counts[here].astype(np.uint32))))
        n = len(rows)
        return pa.table({"block": pa.array([group.column("block")[0].as_py()] * n, pa.int32()),
                         "kind": pa.array([r[0] for r in rows], pa.int32()),
                         "bucket": pa.array([r[1] for r in rows], pa.int32()),
                         "keys": pa.array([r[2] for r in rows], pa.binary()),
                         "counts": pa.array([r[3] for r in rows], pa.binary())})
    return run


def log_probabilities(keys: np.ndarray, counts: np.ndarray, small: np.ndarray) -> np.ndarray:
    """log10 of the probability of each (context, symbol); ``keys`` hold all pairs of their contexts'
    last two bytes, ``small`` the counts of (previous byte, symbol) of the whole corpus."""
    symbol = (keys & np.uint64(511)).astype(np.int64)
    context = keys >> _NINE
    out, live = np.zeros(len(keys)), np.ones(len(keys), bool)
    gone_n = np.zeros(len(keys))  # occurrences and symbols that longer contexts exclude
    gone_d = np.zeros(len(keys))
    order0 = small.sum(axis=0)
    above = None
    for j in range(ORDER, -1, -1):
        if j >= 2:
            suffix = context & np.uint64((1 << 8 * j) - 1)
            pair, at_pair, first = _numbered((suffix << _NINE) | symbol.astype(np.uint64))
            if above is None:
                pair_n = np.bincount(at_pair, counts, len(pair))
            else:  # in how many longer contexts the symbol was seen
                pair_n = np.bincount(at_pair[above[1]], above[2] > 0, len(pair))
            _, node_of_pair, _ = _numbered(pair >> _NINE)
            node = node_of_pair[at_pair]
            n = np.bincount(node_of_pair, pair_n)[node]
            d = np.bincount(node_of_pair, pair_n > 0)[node]
            own = pair_n[at_pair]
            level = (at_pair, first, pair_n, node_of_pair)
        else:
            last = (context & np.uint64(255)).astype(np.int64)
            own = small[last, symbol] if j else order0[symbol]
            n = small.sum(axis=1)[last] if j else np.full(len(keys), order0.sum())
            d = (small > 0).sum(axis=1)[last] if j else np.full(len(keys), (order0 > 0).sum())
        if above is not None:  # what the next longer context has seen is excluded here
            if isinstance(above, tuple):
                at_pair_a, first_a, pair_n_a, node_a = above
                seen = pair_n_a > 0
                gone_n = np.bincount(node_a, np.where(seen, own[first_a], 0))[node_a][at_pair_a]
                gone_d = np.bincount(node_a, seen)[node_a][at_pair_a]
            else:
                gone_n = np.where(small > 0, order0, 0).sum(axis=1)[last_a]
                gone_d = (small > 0).sum(axis=1)[last_a]
        free, kinds = n - gone_n, d - gone_d
        coded = live & (own > 0) & (free > 0)
        out[coded] += np.log10((2 * own - 1)[coded] / (2 * free)[coded])
        live &= ~coded
        escape = live & (free > 0)
        out[escape] += np.log10((kinds / np.maximum(2 * free, 1))[escape])
        above = level if j >= 2 else 1
        if j == 1:
            last_a = last
    out[live] -= math.log10(max(SYMBOLS - int((order0 > 0).sum()), 1))
    return out


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the number of each element's value, and an element for each value."""
    values, first, inverse = np.unique(x, return_index=True, return_inverse=True)
    return values, inverse, first


def _answerer(shared):
    def run(key, group):
        kind = key[0].as_py()
        keys = [_spread(x, np.uint64) for x in group.column("keys").to_pylist()]
        counts = [_spread(x, np.uint32).astype(np.int64) for x in group.column("counts").to_pylist()]
        total, n = _merge(list(zip(keys, counts)))
        value = (log_probabilities(total, n, shared.value).astype(np.float32) if kind == 0
                 else np.minimum(n, 0xFFFFFFFF).astype(np.uint32))
        answers = [_squeeze(value[np.searchsorted(total, k)]) for k in keys]
        known = [int((n > 0).sum())] + [0] * (len(keys) - 1)
        return pa.table({"block": group.column("block"), "kind": group.column("kind"), "keys": group.column("keys"),
                         "answers": pa.array(answers, pa.binary()), "known": pa.array(known, pa.int64())})
    return run


def _unpacked(group: pa.Table) -> list[bytes]:
    unpress = zstandard.ZstdDecompressor()
    return [unpress.decompress(x) for x in group.column("packed").to_pylist()]


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                    ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def _scorer(ends: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tables = {}
        for kind, number in ((0, np.float32), (1, np.uint32)):
            own = answers.filter(pc.equal(answers.column("kind"), kind))
            keys = [_spread(x, np.uint64) for x in own.column("keys").to_pylist()]
            value = [_spread(x, number) for x in own.column("answers").to_pylist()]
            keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            value = np.concatenate(value) if value else np.zeros(0, number)
            order = np.argsort(keys)
            tables[kind] = keys[order], value[order].astype(float)
        texts, score, base, tokens, known = _unpacked(docs), [], [], [], []
        for first, last in _steps(texts):
            keys, bounds = pairs_of(texts[first:last])
            each = tables[0][1][np.searchsorted(tables[0][0], keys)]
            score.append(np.add.reduceat(each, bounds[:-1]))
            words = words_of(pa.array(texts[first:last], pa.binary()).cast(pa.large_binary()))
            c = tables[1][1][np.searchsorted(tables[1][0], words.hashes)] if len(words.hashes) else np.zeros(0)
            n = np.diff(words.bounds)
            text = np.repeat(np.arange(last - first), n)
            base.append(np.bincount(text, np.log10(c + 1), last - first) + math.log10(ends + 1))
            tokens.append(n + 1)
            known.append(np.bincount(text, c > 0, last - first).astype(np.int64) + (ends > 0))
        join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table([docs.column("doc_id"), docs.column("held"), join(tokens, pa.int64()), join(known, pa.int64()),
                         join(base, pa.float64()), join(score, pa.float64())], schema=_SCORE)
    return run


def _totals(batches):
    """Counts of (previous byte, symbol), words and texts of a task's training documents."""
    small, words, texts = np.zeros(256 * 512, np.int64), 0, 0
    for piece in slices(batches):
        raw = [(t or "").encode() for t in piece.column("text").to_pylist()]
        keys, _ = pairs_of(raw)
        small += np.bincount((keys & np.uint64(0x1FFFF)).astype(np.int64), minlength=len(small))
        words += len(words_of(piece.column("text")).hashes)
        texts += len(raw)
    at = np.flatnonzero(small)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, [-1, -2]]), pa.array(np.r_[small[at], [words, texts]])],
                                     names=["pair", "n"])


def _packer(batches):
    press = zstandard.ZstdCompressor(1)
    for piece in slices(batches):
        yield pa.RecordBatch.from_arrays(
            [piece.column("block"), piece.column("doc_id"), piece.column("held"),
             pa.array([press.compress((t or "").encode()) for t in piece.column("text").to_pylist()], pa.binary())],
            names=["block", "doc_id", "held", "packed"])


def scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text."""
    size = text_bytes(docs, text_column)
    blocks = pieces(size, BLOCK_BYTES)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held"),
                       F.col(text_column).alias("text"))
    small, words, ends = np.zeros(256 * 512, np.int64), 0, 0
    for row in (docs.where(~F.col("held")).select("text").mapInArrow(_totals, "pair long, n long")
                .groupBy("pair").agg(F.sum("n").alias("n")).collect()):  # 65,794 rows at most
        if row["pair"] >= 0:
            small[row["pair"]] = row["n"]
        elif row["pair"] == -1:
            words = row["n"]
        else:
            ends = row["n"]
    shared = docs.sparkSession.sparkContext.broadcast(small.reshape(256, 512)[:, :SYMBOLS].copy())
    dealt = (docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
             .select("block", "doc_id", "held", "text")
             .mapInArrow(_packer, "block int, doc_id long, held boolean, packed binary"))
    asked = dealt.groupBy("block").applyInArrow(_asker(blocks), _ASK)
    answers = stored(asked.groupBy("kind", "bucket").applyInArrow(
        _answerer(shared), "block int, kind int, keys binary, answers binary, known long"), "ppm-answers")
    distinct_words = answers.where("kind = 1").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("n")).first()["n"]
    told = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scorer(ends), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    total, kinds = words + ends, distinct_words + (ends > 0)
    return told.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                       (F.col("base") - F.col("n_tokens") * F.lit(math.log10(total + kinds + 1))).alias("base_score"),
                       "score")
