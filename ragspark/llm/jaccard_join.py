"""N-gram Jaccard join over a token-group matrix: every link of similarity >= 0.75, as components.

1. One packed shuffle (``repeats``) finds the documents whose shingles are shared widely enough to
   have a partner at all; equal sets count as one from here on.
2. Sets with the same smallest shingle meet; each joins the first leader it is verified against,
   or leads a group. Groups are connected by construction. A hot group is dealt into pieces.
3. The matrix holds the union of each group: its rare shingles as rows ``token, group`` (any link
   must meet in one of them), its full union beside the members.
4. Groups that share a matrix row may hold a link. Such groups form families (by the largest group
   of their heaviest row), so that a query set visits each family once and never each of thousands
   of similar groups: its overlap with the union of the family is bounded first, and only where the
   bound is reached the members are opened and compared exactly. Components of the links follow.

Nulls and texts without words have an empty set and no links. Repeated rows count as equal sets.
A text of one to four words is one shingle. Only ``id_column`` and ``text_column`` are read.

A very long text is one numpy step of its own. Of equal sets the smallest id stands for all. An
empty table gives an empty result; ``first_of_each`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import sized
from .common import (components, distinct, free_name, frugal, frugal_cogroup, frugal_group, known_id, mix, pieces, public_id,
                     shingles_of, signed, slices, stored, text_bytes, words_of)
from .repeats import BUCKET_KEYS, PACKED, pack, settled

#: Shingles of one part of a group or family, and of the query sets that visit it at a time.
GROUP_TOKENS = 1 << 20
QUERY_TOKENS = 1 << 18
#: Counters of the frequency sketch that orders shingles; 4 MB whatever the corpus holds.
SKETCH = 1 << 20
_CHUNKS = 16


def least_overlap(n: int, percent: int) -> int:
    """Fewest shingles that a set of ``n`` shares with any set it links to."""
    return -(-n * percent // 100)


def linked(shared: int, n: int, m: int, percent: int) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def _set_id(tokens: np.ndarray) -> int:
    return int(signed(mix(mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))))[0])


def _sets(batches, width: int):
    for piece in slices(batches):
        hashes, bounds = shingles_of(words_of(piece.column("text")), width)
        yield piece, [distinct(np.sort(hashes[bounds[i]:bounds[i + 1]])) for i in range(piece.num_rows)]


def _packer(width: int, percent: int, buckets: int):
    """Half of the hash space is sent: a document is settled when enough shingles of this half are
    its own alone, so one that is mostly its own never needs the other half."""
    def run(batches):
        for piece, sets in _sets(batches, width):
            n = np.array([len(s) for s in sets], np.int64)
            need = n - -(-n * percent // 100) + 1
            ids = np.array([_set_id(s) if len(s) else 0 for s in sets], np.int64)
            half = [s[(s & np.uint64(1)) == 0] for s in sets]
            item = np.repeat(np.arange(len(half)), [len(s) for s in half])
            yield pack(np.concatenate(half), item, np.where(n > 0, need, 0),
                       piece.column("id").to_numpy(), ids, n, buckets)
    return run


MEMBERS = "sid long, n int, least long, tokens binary"


def _reader(width: int):
    def run(batches):
        for piece, sets in _sets(batches, width):
            want, rows = piece.column("sid").to_pylist(), []
            for sid, s in zip(want, sets):
                if len(s) and _set_id(s) == sid:
                    rows.append((sid, len(s), int(signed(s[:1])[0]), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["sid", "n", "least", "tokens"])
    return run


def _count_batches(batches):
    total = np.zeros(SKETCH, np.uint32)
    for batch in batches:
        column = batch.column("tokens")
        bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        tokens = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0]:bounds[-1]] if len(column) else b""
        tokens = np.frombuffer(bytes(tokens), np.uint64)
        np.add.at(total, (tokens % np.uint64(SKETCH)).astype(np.int64), 1)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array(
            [x.tobytes() for x in np.split(total, _CHUNKS)], pa.binary())], names=["chunk", "counts"])


def _sum_chunks(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in group.column("counts").to_pylist())
    return pa.table({"chunk": group.column("chunk").slice(0, 1),
                     "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})


def _sketch(members: DataFrame):
    """Frequencies of shingles, hashed into a table of fixed size. It only sets an order: rare
    shingles first. Any order gives the same links."""
    rows = (members.select("tokens").mapInArrow(frugal(_count_batches), "chunk int, counts binary")
            .groupBy("chunk").applyInArrow(_sum_chunks, "chunk int, counts binary").collect())
    total = np.zeros((_CHUNKS, SKETCH // _CHUNKS), np.uint32)
    for row in rows:
        total[row["chunk"]] = np.frombuffer(row["counts"], np.uint32)
    return members.sparkSession.sparkContext.broadcast(total.reshape(-1))


def _rare(tokens: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, as many as it may lack in common with a partner, plus one."""
    keep = len(tokens) - least_overlap(len(tokens), percent) + 1
    order = np.lexsort((tokens, counts[(tokens % np.uint64(len(counts))).astype(np.int64)]))
    return tokens[order[:keep]]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


_GROUPED = pa.schema([("gid", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()),
                      ("other", pa.list_(pa.int64())), ("matrix", pa.binary())])


def _grouper(sketch, percent: int):
    def run(group: pa.Table) -> pa.Table:
        counts = sketch.value
        sets: dict[int, np.ndarray] = {}
        for sid, tokens in zip(group.column("sid").to_pylist(), group.column("tokens").to_pylist()):
            sets[sid] = np.frombuffer(tokens, np.uint64)
        leaders: dict[int, list[int]] = {}  # rare shingle -> sets that lead
        joined: dict[int, int] = {}
        others: dict[int, set[int]] = {}
        matrix: dict[int, list[np.ndarray]] = {}
        for sid in sorted(sets, key=lambda s: (len(sets[s]), s)):
            own = sets[sid]
            rare = _rare(own, counts, percent)
            found = {x for t in rare.tolist() for x in leaders.get(t, ())}
            hits = [x for x in sorted(found) if linked(_shared(own, sets[x]), len(own), len(sets[x]), percent)]
            lead = hits[0] if hits else sid
            joined[sid] = lead
            others.setdefault(lead, set()).update(hits[1:])
            matrix.setdefault(lead, []).append(rare)
            if not hits:
                for t in rare.tolist():
                    leaders.setdefault(t, []).append(sid)
        rows = [(lead, sid, len(sets[sid]), sets[sid].tobytes(),
                 sorted(others[lead]) if sid == lead else None,
                 distinct(np.sort(np.concatenate(matrix[lead]))).tobytes() if sid == lead else None)
                for sid, lead in joined.items()]
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_GROUPED)], schema=_GROUPED)
    return run


def _matrix_rows(batches):
    for batch in batches:
        for gid, n, tokens in zip(batch.column("gid").to_pylist(), batch.column("n").to_pylist(),
                                  batch.column("matrix").to_pylist()):
            t = np.frombuffer(tokens, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), gid)),
                                              pa.array(np.full(len(t), n, np.int32))], names=["token", "gid", "n"])


def _visitor(percent: int):
    """Query sets against one group: bound by the union first, members only behind it.

    Of the links that are found, those are returned that connect something new in this task.
    """
    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        own = [np.frombuffer(x, np.uint64) for x in members.column("tokens").to_pylist()]
        if own and queries.num_rows:
            gids, sizes = members.column("gid").to_numpy(), np.array([len(s) for s in own])
            tokens = np.concatenate(own)
            order = np.argsort(tokens, kind="stable")
            holder = np.repeat(np.arange(len(own)), sizes)[order]
            tokens = tokens[order]
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            union, bounds = tokens[first], np.r_[first, len(tokens)]
            root: dict[int, int] = {}

            def top(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for q, raw in zip(queries.column("q").to_pylist(), queries.column("query").to_pylist()):
                s = np.frombuffer(raw, np.uint64)
                at = np.searchsorted(union, s)
                at = at[union[np.minimum(at, len(union) - 1)] == s]
                if len(at) < least_overlap(len(s), percent):
                    continue
                lengths = bounds[at + 1] - bounds[at]
                ends = np.cumsum(lengths)
                spots = np.arange(ends[-1]) + np.repeat(bounds[at] - (ends - lengths), lengths)
                shared = np.bincount(holder[spots], minlength=len(own))
                hit = 100 * shared >= percent * (len(s) + sizes - shared)
                for g in distinct(np.sort(gids[hit])).tolist():
                    x, y = top(q), top(g)
                    if x != y:
                        root[x] = y
                        out.append((q, g))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run


def _visit(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` among candidates ``q, family``: the sets of q visit the groups of a family. A
    large family is dealt into parts, and one with many visitors is repeated for shares of them."""
    own = groups.select(F.col("gid").alias("q"), "sid", "n", "tokens")
    parts = (groups.where("family is not null").groupBy("family")
             .agg(F.ceil(F.sum("n") / GROUP_TOKENS).cast("int").alias("parts")))
    load = (pairs.join(own.groupBy("q").agg(F.sum("n").alias("n")), "q").groupBy("family")
            .agg(F.ceil(F.sum("n") / QUERY_TOKENS).cast("int").alias("shares")).join(parts, "family"))
    load = stored(load, "jaccard-load")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = (pairs.join(load, "family").withColumn("part", upto("parts")).join(own, "q")
               .select(F.col("family").alias("f"), F.col("part").alias("p"),
                       F.expr("int(pmod(xxhash64(sid), shares))").alias("s"), "q", F.col("tokens").alias("query")))
    opened = (groups.join(load, "family").withColumn("share", upto("shares"))
              .select("family", F.expr("int(pmod(xxhash64(sid), parts))").alias("part"), "share", "gid", "tokens"))
    return (opened.groupBy("family", "part", "share").cogroup(queries.groupBy("f", "p", "s"))
            .applyInArrow(frugal_cogroup(_visitor(percent)), "a long, b long"))


def set_components(members: DataFrame, percent: int) -> DataFrame:
    """``sid, comp``: components of every link among ``members(sid, n, least, tokens)``, named by one of their
    sets. ``tokens`` are sorted 64-bit shingles without repeats, ``least`` the first of them."""
    sketch = _sketch(members)
    hot = (members.groupBy("least").agg(F.ceil(F.sum("n") / GROUP_TOKENS).cast("int").alias("parts"))
           .where("parts > 1"))
    dealt = members.join(hot, "least", "left").withColumn(
        "piece", F.expr("int(pmod(xxhash64(sid), coalesce(parts, 1)))"))
    groups = stored(dealt.select("least", "piece", "sid", "tokens").groupBy("least", "piece")
                    .applyInArrow(frugal_group(_grouper(sketch, percent)),
                                  "gid long, sid long, n int, tokens binary, other array<long>, matrix binary"),
                    "jaccard-groups")
    leads = groups.where("matrix is not null")
    near = leads.select(F.col("gid").alias("a"), F.explode("other").alias("b"))

    weight = groups.groupBy("gid").agg(F.count("*").cast("int").alias("n"))
    rows = (leads.select("gid", "matrix").join(weight, "gid").select("gid", "n", "matrix")
            .mapInArrow(frugal(_matrix_rows), "token long, gid long, n int"))
    lead = (rows.groupBy("token").agg(F.max(F.struct("n", "gid")).alias("main"), F.count("*").alias("k"))
            .where("k > 1").select("token", "main"))
    matrix = stored(rows.join(lead, "token").select("token", "gid", "main"), "jaccard-matrix")
    # a family: groups whose heaviest row has the same largest group; its matrix row is their union
    family = stored(matrix.groupBy("gid").agg(F.max("main").alias("family")), "jaccard-families")
    placed = matrix.select("token", "gid").join(family, "gid")
    columns = placed.select("token", F.col("family").alias("other")).distinct()
    pairs = (placed.join(columns, "token")
             .where("family <= other and not (family = other and family.gid = gid)")
             .select(F.col("gid").alias("q"), F.col("other.gid").alias("family")).distinct())
    pairs = stored(pairs, "jaccard-pairs")
    tagged = groups.join(family.select("gid", F.col("family.gid").alias("family")), "gid", "left")
    found = components(near.unionByName(_visit(pairs, tagged, percent)))

    return (groups.select("sid", "gid").join(found.withColumnRenamed("node", "gid"), "gid", "left")
            .select("sid", F.coalesce("component", "gid").alias("comp")).distinct())


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5,
                       percent: int = 75) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id`` (smallest id reachable by links)."""
    docs = docs.select(known_id(id_column).alias("id"), F.col(text_column).alias("text"))
    # about six bytes of text a shingle; half of the shingles are sent
    buckets = min(pieces(text_bytes(docs), 12 * BUCKET_KEYS), 32_000)
    sets = stored(settled(docs.mapInArrow(frugal(_packer(width, percent, buckets)), PACKED)), "jaccard-sets")
    sets = sets.select(F.col("a").alias("id"), F.col("b").alias("sid"), F.col("c").cast("int").alias("n"), "open")
    firsts = sets.where("n > 0").groupBy("sid", "n").agg(F.min("id").alias("id"), F.max("open").alias("open"))

    wanted = firsts.where("open").select("id", "sid")
    read = docs.join(sized(wanted, ["id", "sid"], 16 << 20), "id").select("id", "sid", "text")
    members = stored(read.mapInArrow(frugal(_reader(width)), MEMBERS), "jaccard-members")
    label = set_components(members, percent)
    classed = firsts.join(label, "sid", "left").select(
        "sid", "n", "id", F.coalesce("comp", "sid").alias("comp"), F.col("comp").isNotNull().alias("grouped"))
    names = classed.groupBy("grouped", "comp").agg(F.min("id").alias("name"))
    named = classed.join(names, ["grouped", "comp"]).select("sid", "n", "name")
    return (sets.join(named, ["sid", "n"], "left")
            .select(public_id("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("name", "id").alias("name"))
            .select("doc_id", "n_shingles", public_id("name").alias("component_id")))


def first_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row of each group of linked documents, that with the smallest id; rows without words stay.

    Rows are told apart by id and text, so a row with a text of its own stays whatever other rows of
    its id do, and of rows that are the same in both one stays. Only ids and text hashes are shuffled,
    and the texts where such rows occur.
    """
    key, sort = free_name(docs, "_text"), free_name(docs, "_id")
    keyed = docs.withColumn(key, F.xxhash64(text_column)).withColumn(sort, known_id(id_column))
    wordy = F.coalesce(F.col(text_column).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = jaccard_components(keyed.where(wordy).select(F.col(key).alias("key"), F.col(text_column).alias("text")),
                               "key", "text", **options)
    groups = found.select(F.col("doc_id").alias("key"), "component_id").distinct()
    least = keyed.where(wordy).groupBy(F.col(key).alias("key")).agg(F.min(sort).alias("id"))
    heads = (least.join(groups, "key").groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("head"))
             .select(F.col("head.id").alias(sort), F.col("head.key").alias(key)))
    heads = stored(heads, "jaccard-heads")
    kept = keyed.where(wordy).join(sized(heads, [sort, key], 16 << 20), [sort, key], "left_semi")
    if kept.select(sort, key).groupBy(sort, key).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([sort, key])
    return kept.unionByName(keyed.where(~wordy)).select(*docs.columns)
