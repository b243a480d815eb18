"""Benchmark decontamination by spaced seeds.

A mask names the token places of a window that count; the others may hold anything. Windows of the
benchmark and of the documents that agree on the counted places give hits on a diagonal (document
place minus item place), and along each diagonal that was hit the run with the best sum (a match
adds 1, a substitution takes 2) decides: a document is contaminated by an item when the sum reaches
``LEAST_SUM``, or four fifths of a shorter item. Substitutions between the counted places, and runs
of matches around them, therefore don't hide a passage.

Tokens are runs of letters and digits, lower-cased. Items of fewer than ``SHORTEST`` tokens are not
searched; items shorter than a mask are searched as a whole, without substitutions. Null and empty
texts hit nothing. Repeated rows give one result row; rows with equal ids count as one document. A
null id is reported as null. Other columns are not read. DataFrame functions only: the windows of
all documents meet the seeds in counted broadcasts, as many as the size of the benchmark asks for.

Very long texts are hashed in the JVM as one array of words. Items without an id are reported without
one; texts under one item id are all compared, and the best counts; of equal scores the smaller
offset. Empty tables give empty results; other columns are kept by ``decontaminated``, else not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized
from .common import free_name, known_id, pieces, public_id, stored

#: Counted places of the masks.
MASKS = ((0, 1, 2, 4, 7, 8, 10), (0, 1, 3, 5, 6, 9, 10), (0, 2, 3, 6, 8, 9, 10))
SPAN = 11
SHORTEST = 5
LEAST_SUM = 13
#: Seeds of one broadcast, about 60 bytes each.
SEEDS = 200_000


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashed(text: Column) -> Column:
    return F.transform(_tokens(text), lambda t: F.xxhash64(t))


def _windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``pos, seed`` of every window of the token hashes ``h``, beside the other columns of ``df``."""
    df = df.where(F.size("h") >= SHORTEST).withColumn("n", F.size("h"))
    df = df.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - SHORTEST)))

    def seed(kind: int, places) -> Column:
        return F.when(F.col("pos") + (max(places) + 1) <= F.col("n"),
                      F.xxhash64(F.lit(kind), *[F.get("h", F.col("pos") + o) for o in places]))

    seeds = [seed(k, m) for k, m in enumerate(MASKS)] + [seed(100 + n, range(n)) for n in lengths]
    return df.withColumn("seed", F.explode(F.array(*seeds))).where("seed is not null")


def _best_sum(doc: Column, item: Column) -> Column:
    """Largest sum of a run, of 1 for each match and -2 for each substitution."""
    worth = F.zip_with(doc, item, lambda x, y: F.when(x == y, F.lit(1)).otherwise(F.lit(-2)))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s, x):
        now = F.greatest(s["now"] + x, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))
    return F.aggregate(worth, start, step, lambda s: s["best"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, offset, score``: the best diagonal of each contaminated document and item.
    ``offset`` is the document's token at which the item would begin."""
    items = (benchmark.select(known_id(item_column).alias("item"), _hashed(F.col(item_text)).alias("h"))
             .where(F.size("h") >= SHORTEST))
    items = stored(items, "seed-items")
    lengths = [r["n"] for r in items.select(F.size("h").alias("n")).where(F.col("n") < SPAN).distinct().collect()]
    short = items.where(F.size("h") < SPAN)
    seeds = (_windows(items.where(F.size("h") >= SPAN), []).select("seed", "item", "pos")
             .unionByName(short.select(F.coalesce(*[
                 F.when(F.size("h") == n, F.xxhash64(F.lit(100 + n), *[F.get("h", F.lit(o)) for o in range(n)]))
                 for n in [*lengths, SPAN]]).alias("seed"), "item", F.lit(0).alias("pos"))))
    seeds = stored(seeds.select("seed", "item", F.col("pos").alias("item_pos")).distinct(), "seeds")
    slim = docs.select(known_id(id_column).alias("id"), F.col(text_column).alias("text"))
    windows = _windows(slim.select("id", _hashed(F.col("text")).alias("h")), sorted(lengths)).select("id", "pos", "seed")
    blocks, found = pieces(seeds.count(), SEEDS), None
    for k in range(blocks):  # the whole benchmark, block by block
        block = F.broadcast(seeds.where(F.pmod("seed", F.lit(blocks)) == k))
        part = windows.join(block, "seed").select("id", "item", (F.col("pos") - F.col("item_pos")).alias("offset"))
        found = part if found is None else found.unionByName(part)
    hits = stored(found.distinct(), "seed-hits")
    seen = (slim.join(sized(hits.select("id").distinct(), ["id"], 16 << 20), "id", "left_semi")
            .select("id", _hashed(F.col("text")).alias("h")))
    pairs = hits.join(seen, "id").join(
        sized(items.withColumn("bytes", F.array_join(F.col("h").cast("array<string>"), ",")), ["bytes"], 16 << 20)
        .select("item", F.col("h").alias("g")), "item")
    first, item_first = F.greatest(F.col("offset"), F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    length = F.least(F.size("h") - first, F.size("g") - item_first)
    judged = (pairs.withColumn("length", length).where("length > 0")
              .withColumn("score", _best_sum(F.slice("h", first + 1, F.col("length")),
                                             F.slice("g", item_first + 1, F.col("length"))))
              .where(F.col("score") >= F.least(F.lit(LEAST_SUM), F.ceil(F.size("g") * 4 / F.lit(5)))))
    best = judged.groupBy("id", "item").agg(F.max(F.struct("score", (-F.col("offset")).alias("o"))).alias("m"))
    return best.select(public_id("id").alias("doc_id"), public_id("item").alias("item_id"),
                       (-F.col("m.o")).cast("long").alias("offset"), F.col("m.score").cast("long").alias("score"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   **options) -> DataFrame:
    """Documents without any contaminated passage, with all their columns. A document goes for its text,
    whatever its id: clean rows stay beside contaminated ones of the same id, or without one."""
    keyed = docs.select(F.xxhash64(text_column).alias("key"), F.col(text_column).alias("text"))
    gone = free_name(docs, "_gone")
    found = contaminated(keyed, benchmark, "key", **options).select(known_id("doc_id").alias(gone)).distinct()
    found = stored(found, "seed-gone")
    return docs.join(sized(found, [gone], 16 << 20), F.xxhash64(text_column) == F.col(gone), "left_anti")
