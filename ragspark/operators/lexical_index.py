"""The text index: postings in blocks by term, document frequencies, statistics, versions.

Postings hold one row per (field, term, article) with the term frequency and, copied next to it,
the length of that field, so scoring never joins back to a length table. They are stored by
*part*, a hash of field and term, so that a search reads the parts of its terms only; a large corpus
is first cut into slices of articles, which bounds what one term has in one part. Within a part the
postings of a term lie in tiers: the ``BLOCK`` that weigh most are block 0, the next ``BLOCK * 2**j``
are dealt to the blocks ``2**j .. 2**(j + 1) - 1`` by a hash of the article, for j = 0, 1, ... A block
carries the highest ``share`` (the part of the score that depends on the article alone) of its
postings. So a search that knows a lower bound of its result skips blocks by their maximum, and one
that knows its candidates skips the blocks none of them can lie in.

An index is a list of segments under a folder. Building writes one; ``update_index`` adds a small
one with new and changed articles, marks of the articles it replaces, and signed differences of
frequencies and statistics, so they equal those of an index built from scratch. ``merge_index``
turns all into one again. A version is a small table that names its segments and is written last:
whatever dies before leaves the version before in force, and a running search keeps its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import cut, needed, pieces_of, sized
from ..sources.tables import finished_folders, folders, union_all, write_table
from .term_keys import key_part, vocabulary_keys

FIELDS = ("title", "text")
ROW_GROUP_BYTES = 32 * 1024 * 1024
# Fixed values of the scoring formula.
K1 = 1.2
B = 0.75
BLOCK = 512
# Bits of an article's hash that travel with its postings: those that the tiers of blocks use.
LOW_BITS = (1 << 31) - 1
# Postings of one batch that a part is written in.
BATCH_POSTINGS = 500_000
#: Text bytes that one part is meant to hold, and how many parts there may be. A task of the build
#: holds one part as arrays: small parts keep the largest task small.
PART_BYTES = 16 * 1024 * 1024
LEAST_PARTS, MOST_PARTS = 16, 4096
#: Articles of one slice; no term has more postings in one part.
SLICE_ARTICLES = 1_000_000

_VERSION = "number INT, folder STRING, parts INT, slices INT, field STRING, avgdl DOUBLE"
_TERMS = "field STRING, term STRING, df BIGINT, top DOUBLE, part INT"


@dataclass(frozen=True)
class Segment:
    """Blocks of one write. ``avgdl`` are the mean lengths its block maxima were taken with."""

    number: int
    blocks: DataFrame
    parts: int
    slices: int
    avgdl: dict[str, float]


@dataclass(frozen=True)
class LexicalIndex:
    """Tables of a text index; ``articles`` holds ``article_id, title, text``.

    ``doc_freq`` has ``field, term, df, top``, the last an upper bound of the term's shares.
    ``term_keys`` are tables of the terms' segment keys by part, with the number of parts; they may
    also hold terms that no article has any more.
    ``dead`` names articles whose postings in segments before ``since`` no longer count.
    """

    articles: DataFrame
    doc_freq: DataFrame
    stats: DataFrame
    segments: tuple[Segment, ...]
    dead: DataFrame | None = None
    version: int = 0
    term_keys: tuple[tuple[DataFrame, int], ...] = ()

    @property
    def postings(self) -> DataFrame:
        """(field, term, article_id, dl, tf) of all live postings."""
        return union_all([self.live(s, posting_rows(s.blocks)) for s in self.segments])

    def live(self, segment: Segment, rows: DataFrame) -> DataFrame:
        """Rows of a segment without those of articles that a later segment replaced."""
        if self.dead is None:
            return rows
        gone = self.dead.where(F.col("since") > segment.number).select("article_id")
        return rows.join(sized(gone, ["article_id"]), "article_id", "left_anti").select(*rows.columns)


def _fields(articles: DataFrame, fields) -> DataFrame:
    """(article_id, field, terms): one scan of the articles for all fields."""
    parts = [F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in fields]
    return articles.select("article_id", F.inline(F.array(*parts)))


def tokenize(articles: DataFrame, fields=FIELDS) -> DataFrame:
    """(field, article_id, position, term), one row per token."""
    return _fields(articles, fields).select(
        "field", "article_id", F.posexplode("terms").alias("position", "term"))


def field_lengths(articles: DataFrame, fields=FIELDS) -> DataFrame:
    """(field, article_id, dl) for fields that hold a token. Row by row, no shuffle."""
    return (_fields(articles, fields)
            .select("field", "article_id", F.size("terms").cast("long").alias("dl"))
            .where("dl > 0"))


def postings(articles: DataFrame, fields=FIELDS) -> DataFrame:
    """(field, term, article_id, dl, tf)."""
    rows = _fields(articles, fields).select(
        "field", "article_id", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("field", "term", "article_id", "dl").agg(F.count("*").alias("tf"))


def posting_runs(articles: DataFrame, fields=FIELDS, slices: int = 1) -> DataFrame:
    """(slice, field, term, article_id, dl, tf, hash): the rows of ``postings``, those of one task, term and slice
    of articles as arrays in one row. Rows of equal ``article_id`` must lie in one task, which holds the tokens
    of all its articles.
    """
    kind = articles.schema["article_id"].dataType.simpleString()
    rows = _fields(articles, fields).select("article_id", "field", "terms", F.xxhash64("article_id").alias("hash"))
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, field, length, hashes, codes = [], [], [], [], []
        for batch in batches:
            ids.append(batch.column(0))
            field.append(pc.index_in(batch.column(1), value_set=pa.array(names)).to_numpy())
            length.append(batch.column(2).value_lengths().fill_null(0).to_numpy().astype(np.int64))
            hashes.append(batch.column(3).to_numpy())
            codes.append(batch.column(2).flatten().dictionary_encode())
        if sum(map(len, codes)):
            yield from _task_runs(pa.chunked_array(ids).combine_chunks(), np.concatenate(field), np.concatenate(length),
                                  np.concatenate(hashes), pa.chunked_array(codes), pa.array(names), slices)

    return rows.mapInArrow(run, f"slice int, field string, term string, article_id array<{kind}>, dl array<int>, "
                                "tf array<int>, hash array<int>")


def _task_runs(ids: pa.Array, field: np.ndarray, dl: np.ndarray, hashes: np.ndarray, tokens_: pa.ChunkedArray,
               names: pa.Array, slices: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows ``ids, field, dl, hashes``, whose tokens follow one another."""
    tokens_ = tokens_.unify_dictionaries().combine_chunks()
    terms, term = tokens_.dictionary, tokens_.indices.to_numpy().astype(np.int64)
    # rows equal in article, field and length are one
    article = ids.dictionary_encode().indices.to_numpy().astype(np.int64)
    _, row, group = np.unique((article * len(names) + field) * (dl.max() + 1) + dl, return_index=True, return_inverse=True)
    key = (np.repeat(field, dl) * len(terms) + term) * len(row) + np.repeat(group, dl)
    key, tf = np.unique(key, return_counts=True)
    row, key = row[key % len(row)], key // len(row)
    if slices > 1:
        key = key * slices + hashes[row] % slices
        order = np.argsort(key, kind="stable")
        row, key, tf = row[order], key[order], tf[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end, tf = np.r_[begin[1:], len(key)], tf.astype(np.int32)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + BATCH_POSTINGS, side="right")))
        lo, hi = begin[at], end[to - 1]
        which, here = row[lo:hi], key[begin[at:to]]
        offsets = pa.array(np.r_[begin[at:to], hi] - lo, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(here % slices, pa.int32()), names.take(pa.array(here // slices // len(terms))),
             terms.take(pa.array(here // slices % len(terms))),
             *[pa.ListArray.from_arrays(offsets, column) for column in (
                 ids.take(pa.array(which)), pa.array(dl[which], pa.int32()), pa.array(tf[lo:hi]), pa.array(hashes[which] & LOW_BITS, pa.int32()))]],
            ["slice", "field", "term", "article_id", "dl", "tf", "hash"])
        at = to


def field_totals(lengths: DataFrame) -> DataFrame:
    """(field, n, total): articles that hold the field, and their lengths together."""
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").alias("total"))


def corpus_stats(totals: DataFrame) -> DataFrame:
    """(field, n, avgdl)."""
    return totals.select("field", "n", (F.col("total") / F.col("n")).alias("avgdl"))


def share(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What an article gives to the score of a term, below 1; rises with ``avgdl`` at most in proportion."""
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


def term_part(parts: int, field: str = "field", term: str = "term") -> Column:
    return F.pmod(F.xxhash64(field, term), F.lit(parts)).cast("int")


def tier_block(tier: Column) -> Column:
    """Block of an article in a tier; tier -1 is the head, block 0."""
    size = F.call_function("shiftleft", F.lit(1), F.greatest(tier, F.lit(0)).cast("int"))
    return F.when(tier < 0, 0).otherwise(size + F.pmod(F.xxhash64("article_id"), size)).cast("int")


def _ranks(names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different values in order, and the place of each row's value among them."""
    codes = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    codes = codes if pa.types.is_dictionary(codes.type) else codes.dictionary_encode()
    order = pc.sort_indices(codes.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return codes.dictionary.take(order), rank[codes.indices.to_numpy()]


def _part_blocks(held: pa.Table, means: dict[str, float], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the postings of one part, by field, term and block."""
    fields, field = _ranks(held.column("field").unify_dictionaries())
    terms, term = _ranks(held.column("term").unify_dictionaries())
    ids = held.column("article_id").combine_chunks()
    number = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else _ranks(ids)[1]
    tf, dl = (held.column(c).to_numpy() for c in ("tf", "dl"))
    weight = share(tf.astype(np.float64), dl.astype(np.float64), np.array([means[f] for f in fields.to_pylist()])[field])
    key = field * len(terms) + term
    order = np.lexsort((number, -weight, key))  # of each term the heaviest first
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    nth = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    tier = np.log2(nth // block + 1).astype(np.int64) - 1
    size = np.left_shift(1, np.maximum(tier, 0))
    place = np.where(tier < 0, 0, size + held.column("hash").to_numpy()[order] % size)
    by_block = np.lexsort((place, key))  # stable: a block begins with its heaviest posting
    order, key, place = order[by_block], key[by_block], place[by_block]
    begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
    end = np.r_[begin[1:], len(key)]
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + BATCH_POSTINGS, side="right")))
        here, which = begin[at:to], order[begin[at]:end[to - 1]]
        offsets = pa.array(np.r_[here, end[to - 1]] - begin[at], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [held.column("part").combine_chunks().take(pa.array(order[here])), fields.take(pa.array(key[here] // len(terms))),
             terms.take(pa.array(key[here] % len(terms))), pa.array(place[here], pa.int32()),
             pa.array(end[at:to] - here, pa.int32()), pa.array(weight[order[here]]),
             *[pa.ListArray.from_arrays(offsets, pa.array(column)) for column in (ids.take(pa.array(which)), dl[which], tf[which])]],
            ["part", "field", "term", "block", "n", "top", "articles", "dls", "tfs"])
        at = to


def _rows_of(batch: pa.RecordBatch) -> pa.Table:
    """A batch of postings, or of runs of postings, as a table of postings that holds a text once."""
    columns = {name: batch.column(name) for name in batch.schema.names}
    for name in ("field", "term"):
        columns[name] = columns[name].dictionary_encode()
    if pa.types.is_list(columns["article_id"].type):
        row = pa.array(np.repeat(np.arange(len(batch)), columns["article_id"].value_lengths().to_numpy()))
        columns = {name: c.flatten() if pa.types.is_list(c.type) else c.take(row) for name, c in columns.items()}
    return pa.table(columns)


def blocks_of(rows: DataFrame, stats: DataFrame, parts: int, slices: int) -> DataFrame:
    """(part, field, term, block, n, top, articles, dls, tfs) of ``postings`` or of ``posting_runs`` made with
    ``slices``: one shuffle of the postings, one task for each part, which orders and cuts them as arrays."""
    means, block = {r["field"]: r["avgdl"] for r in stats.collect()}, BLOCK  # one row per field
    if "slice" in rows.columns:
        kind = rows.schema["article_id"].dataType.elementType.simpleString()
        known = rows
    else:
        kind = rows.schema["article_id"].dataType.simpleString()
        known = rows.select("*", F.xxhash64("article_id").alias("hash")).select(
            F.pmod("hash", F.lit(slices)).cast("int").alias("slice"), "field", "term", "article_id",
            F.col("dl").cast("int").alias("dl"), F.col("tf").cast("int").alias("tf"),
            F.col("hash").bitwiseAND(F.lit(LOW_BITS)).cast("int").alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_rows_of(batch) for batch in batches]
        if held and sum(map(len, held)):
            whole = pa.concat_tables(held)
            held.clear()
            numbers = pc.unique(whole.column("part")).to_pylist()
            for number in sorted(numbers):
                yield from _part_blocks(whole.filter(pc.equal(whole.column("part"), number)) if len(numbers) > 1 else whole, means, block)

    return (known.where(F.col("field").isin(list(means)))
            .select((F.col("slice") * parts + term_part(parts)).alias("part"), "field", "term", "article_id", "dl", "tf", "hash")
            .repartitionById(parts * slices, F.col("part"))
            .mapInArrow(run, f"part int, field string, term string, block int, n int, top double, articles array<{kind}>, "
                             "dls array<int>, tfs array<int>"))


def posting_rows(blocks: DataFrame, *keep: str) -> DataFrame:
    """(field, term, *keep, article_id, dl, tf) of blocks."""
    keys = ["field", "term", *keep]
    return blocks.select(*keys, F.inline(F.arrays_zip("articles", "dls", "tfs"))).select(
        *keys, F.col("articles").alias("article_id"), F.col("dls").cast("long").alias("dl"), F.col("tfs").cast("long").alias("tf"))


def document_frequency(blocks: DataFrame) -> DataFrame:
    """(field, term, df, top); reads no posting."""
    return blocks.groupBy("field", "term").agg(F.sum(F.col("n").cast("long")).alias("df"), F.max("top").alias("top"))


def _layout(articles: DataFrame, fields, parts: int | None) -> tuple[int, int, int]:
    """Parts and slices for the counted text, and tasks for its tokens."""
    size = articles.agg(F.count("*").alias("rows"), F.coalesce(F.sum(sum(
        (F.coalesce(F.octet_length(f), F.lit(0)).cast("long") for f in fields), F.lit(0))), F.lit(0)).alias("bytes")).first()
    slices = pieces_of(size["rows"], SLICE_ARTICLES)
    wanted = parts or min(max(pieces_of(size["bytes"], PART_BYTES * slices), LEAST_PARTS), MOST_PARTS)
    tasks = max(pieces_of(size["bytes"], PART_BYTES), articles.sparkSession.sparkContext.defaultParallelism)
    return wanted, slices, tasks


def build_index(articles: DataFrame, fields=FIELDS, parts: int = LEAST_PARTS) -> LexicalIndex:
    """Index defined over ``articles`` without writing anything."""
    stats = corpus_stats(field_totals(field_lengths(articles, fields)))
    blocks = blocks_of(postings(articles, fields), stats, parts, 1)
    avgdl = {r["field"]: r["avgdl"] for r in stats.collect()}  # one row per field
    return LexicalIndex(articles, document_frequency(blocks), stats, (Segment(1, blocks, parts, 1, avgdl),))


# --- stored segments and versions -------------------------------------------------------------

def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of an index, oldest first."""
    return sorted(int(name) for name in finished_folders(spark, f"{path}/versions") if name.isdigit())


def save_index(articles: DataFrame, path: str, fields=FIELDS, mode: str = "ignore",
               parts: int | None = None) -> LexicalIndex:
    """Write an index of one segment under ``path`` as a new version and return it as read back.

    ``mode='ignore'`` leaves an existing index alone. The articles are shuffled once, as raw text,
    by article; tokens are counted where they land. ``parts`` follows the counted bytes unless given.
    """
    spark = articles.sparkSession
    if mode == "ignore" and versions(spark, path):
        return load_index(spark, path)
    source = articles.select("article_id", *fields)
    wanted, slices, tasks = _layout(source, fields, parts)
    folder = _new_folder()
    write_table(source, f"{path}/{folder}/articles")
    source = spark.read.parquet(f"{path}/{folder}/articles")
    write_table(field_totals(field_lengths(source, fields)).coalesce(1), f"{path}/{folder}/totals")
    _write_blocks(spark, path, folder, posting_runs(source.repartition(tasks, "article_id"), fields, slices), wanted, slices)
    _write_terms(document_frequency(_read_blocks(spark, f"{path}/{folder}")), path, folder, wanted)
    _write_version(spark, path, [_entry(spark, path, 1, folder, wanted, slices)])
    return load_index(spark, path)


def _read_blocks(spark, base: str) -> DataFrame:
    """Blocks of a segment, which may be empty."""
    kind = spark.read.parquet(f"{base}/articles").schema["article_id"].dataType.simpleString()
    return spark.read.schema(f"field STRING, term STRING, block INT, n INT, top DOUBLE, articles ARRAY<{kind}>, "
                             "dls ARRAY<INT>, tfs ARRAY<INT>, part INT").parquet(f"{base}/blocks")


def _read_terms(spark, base: str) -> DataFrame:
    return spark.read.schema(_TERMS).parquet(f"{base}/terms")


def _read_keys(spark, base: str) -> DataFrame:
    return spark.read.schema("field STRING, term STRING, key BIGINT, part INT").parquet(f"{base}/keys")


def _new_folder() -> str:
    return f"segment-{uuid.uuid4().hex[:12]}"


def _write_blocks(spark, path: str, folder: str, rows: DataFrame, parts: int, slices: int) -> None:
    stats = corpus_stats(spark.read.parquet(f"{path}/{folder}/totals").where("n > 0"))
    blocks = blocks_of(rows, stats, parts, slices).sortWithinPartitions("part", "field", "term", "block")
    write_table(blocks, f"{path}/{folder}/blocks", partition_by=["part"], row_group_bytes=ROW_GROUP_BYTES)


def _write_terms(terms: DataFrame, path: str, folder: str, parts: int) -> None:
    write_table(terms.withColumn("part", term_part(parts)).repartition(parts, "part").sortWithinPartitions("part", "field", "term"),
                f"{path}/{folder}/terms", partition_by=["part"])
    keys = vocabulary_keys(_read_terms(terms.sparkSession, f"{path}/{folder}").where("df > 0").select("field", "term"))
    # a key that very many terms share is cut into files, not gathered in one task
    write_table(keys.withColumn("part", key_part(parts)).hint("rebalance", "part"), f"{path}/{folder}/keys", partition_by=["part"])


def _entry(spark, path: str, number: int, folder: str, parts: int, slices: int) -> list[tuple]:
    totals = spark.read.parquet(f"{path}/{folder}/totals").where("n > 0")
    means = {r["field"]: r["avgdl"] for r in corpus_stats(totals).collect()}  # one row per field
    return [(number, folder, parts, slices, f, m) for f, m in (means or {"": 0.0}).items()]


def _write_version(spark, path: str, entries: list[list[tuple]]) -> None:
    # a write that died may have left a folder; its number is not used again
    version = max((int(n) for n in folders(spark, f"{path}/versions") if n.isdigit()), default=0) + 1
    rows = spark.createDataFrame([row for entry in entries for row in entry], _VERSION)
    write_table(rows.coalesce(1), f"{path}/versions/{version}", mode="error")


def load_index(spark: SparkSession, path: str, version: int | None = None) -> LexicalIndex:
    """The newest finished version, or the one asked for."""
    version = version or max(versions(spark, path))
    rows = spark.read.schema(_VERSION).parquet(f"{path}/versions/{version}").collect()  # segments x fields
    entries: dict[tuple, dict] = {}
    for r in rows:
        entries.setdefault((r["number"], r["folder"], r["parts"], r["slices"]), {})[r["field"]] = r["avgdl"]
    at = {number: f"{path}/{folder}" for number, folder, _, _ in entries}
    segments = tuple(Segment(number, _read_blocks(spark, at[number]), parts, slices, avgdl)
                     for (number, _, parts, slices), avgdl in sorted(entries.items()))
    keys = tuple((_read_keys(spark, at[s.number]), s.parts) for s in segments)
    if len(segments) == 1:
        home = at[segments[0].number]
        stats = corpus_stats(spark.read.parquet(f"{home}/totals"))
        return LexicalIndex(spark.read.parquet(f"{home}/articles"), _read_terms(spark, home),
                            stats, segments, None, version, keys)
    first, *later = (s.number for s in segments)
    totals = union_all([spark.read.parquet(f"{at[first]}/totals").select("field", "n", "total"),
                        *(spark.read.parquet(f"{at[s]}/changed_totals") for s in later)])
    stats = corpus_stats(totals.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0"))
    means = {r["field"]: r["avgdl"] for r in stats.collect()}  # one row per field
    terms = union_all([
        _read_terms(spark, at[s.number]).select("field", "term", "df", (F.col("top") * _grown(s, means)).alias("top"))
        for s in segments])
    terms = terms.groupBy("field", "term").agg(F.sum("df").alias("df"), F.max("top").alias("top")).where("df > 0")
    dead = union_all([spark.read.parquet(f"{at[s]}/dead").select("article_id", F.lit(s).alias("since")) for s in later])
    dead = dead.groupBy("article_id").agg(F.max("since").alias("since"))
    index = LexicalIndex(spark.read.parquet(f"{at[first]}/articles"), terms, stats, segments, dead, version, keys)
    texts = union_all([index.live(s, spark.read.parquet(f"{at[s.number]}/articles")) for s in segments])
    return LexicalIndex(texts, terms, stats, segments, dead, version, keys)


def growth(segment: Segment, means: dict[str, float]) -> dict[str, float]:
    """How far a share may lie above the one its block maximum was taken with."""
    return {f: max(1.0, m / segment.avgdl[f]) if segment.avgdl.get(f) else 1.0 for f, m in means.items()}


def _grown(segment: Segment, means: dict[str, float]) -> Column:
    factors = growth(segment, means)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])[F.col("field")], F.lit(1.0))


def update_index(spark: SparkSession, path: str, changed: DataFrame, deleted: DataFrame | None = None,
                 fields=FIELDS) -> LexicalIndex:
    """Add, replace and delete articles; the work follows the change, not the index.

    ``changed`` holds ``article_id`` and the fields (of rows with equal ids one is kept, the greatest);
    ``deleted`` holds ``article_id``. An id in both is replaced; unknown ids are ignored by deletion.
    Of the old index only the touched articles are read, to take their words out of the frequencies.
    """
    old = load_index(spark, path)
    row = F.struct(*fields)
    new = cut(changed.groupBy("article_id").agg(F.max(row).alias("row")).select("article_id", "row.*"))
    touched = new.select("article_id")
    if deleted is not None:
        touched = touched.unionByName(deleted.select("article_id")).distinct()
    before = cut(needed(old.articles.select("article_id", *fields), touched, "article_id"))
    number, folder = old.segments[-1].number + 1, _new_folder()
    parts, slices, _ = _layout(new, fields, None)
    base = f"{path}/{folder}"
    write_table(new, f"{base}/articles")
    write_table(before.select("article_id"), f"{base}/dead")
    totals = field_totals(field_lengths(new, fields))
    write_table(totals.coalesce(1), f"{base}/totals")
    minus = field_totals(field_lengths(before, fields)).select("field", (-F.col("n")).alias("n"), (-F.col("total")).alias("total"))
    write_table(totals.unionByName(minus).coalesce(1), f"{base}/changed_totals")
    _write_blocks(spark, path, folder, postings(new, fields), parts, slices)
    gone = (postings(before, fields).groupBy("field", "term").agg((-F.count("*")).alias("df"))
            .withColumn("top", F.lit(0.0)))
    plus = document_frequency(_read_blocks(spark, base))
    _write_terms(plus.unionByName(gone).groupBy("field", "term").agg(F.sum("df").alias("df"), F.max("top").alias("top")),
                 path, folder, parts)
    _write_version(spark, path, [*_entries(spark, path, old.version), _entry(spark, path, number, folder, parts, slices)])
    return load_index(spark, path)


def _entries(spark, path: str, version: int) -> list[list[tuple]]:
    rows = spark.read.schema(_VERSION).parquet(f"{path}/versions/{version}").collect()
    return [[tuple(r) for r in rows]]


def merge_index(spark: SparkSession, path: str) -> LexicalIndex:
    """Turn all segments into one. Postings are carried over, no text is analyzed again."""
    old = load_index(spark, path)
    if len(old.segments) == 1:
        return old
    folder = _new_folder()
    base = f"{path}/{folder}"
    fields = [f for f in old.articles.columns if f != "article_id"]
    parts, slices, _ = _layout(old.articles, fields, None)
    write_table(old.articles, f"{base}/articles")
    totals = old.stats.select("field", "n", F.round(F.col("avgdl") * F.col("n")).cast("long").alias("total"))
    write_table(totals.coalesce(1), f"{base}/totals")
    _write_blocks(spark, path, folder, old.postings, parts, slices)
    _write_terms(document_frequency(_read_blocks(spark, base)), path, folder, parts)
    _write_version(spark, path, [_entry(spark, path, 1, folder, parts, slices)])
    return load_index(spark, path)
