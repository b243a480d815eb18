"""Line dedup by the number of distinct sites a line is seen on.

Each line's sites are kept as a HyperLogLog sketch; partial sketches merge in the aggregation, so a
line in every document costs one sketch per task. Lines whose estimate is within the error of the
threshold get an exact distinct count. What is on ``min_sites`` sites or more is boilerplate: it
stays where it is seen first (smallest id, first place) and goes everywhere else.

A line is compared without surrounding blanks and without its letter case; blank lines are never
touched. A null text stays null, a null site is a site of its own, null ids come last. Rows with
equal ids lose the same lines. All columns of the input are returned, but that the two counts take the
place of columns of their names.

Very long texts are cut into their lines in the JVM. An empty table comes back empty; columns of the
caller stay, whatever their names, but for ``n_lines`` and ``n_removed``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized
from .common import free_name, known_id, stored

MIN_SITES = 8
LOG_REGISTERS = 10
#: Relative standard error of the sketch, and how many of it count as near.
ERROR, NEAR = 1.04 / (1 << (LOG_REGISTERS // 2)), 4

#: Removal lists are broadcast up to this counted size, else joined by document.
HITS_BYTES = 16 << 20


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(line)))


def _lines(docs: DataFrame) -> DataFrame:
    return (docs.select("id", "site", F.posexplode(F.split("text", "\n")).alias("at", "line"))
            .where(F.trim("line") != "").select("id", "site", "at", _line_hash(F.col("line")).alias("line")))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``line`` (hash), ``id`` and ``at`` of its first place, for lines on ``min_sites`` sites or more.
    ``docs``: ``id, site, text``."""
    spread = _lines(docs).groupBy("line").agg(
        F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"), F.min(F.struct("id", "at")).alias("first"))
    low, high = min_sites * (1 - NEAR * ERROR), min_sites * (1 + NEAR * ERROR)
    spread = spread.withColumn("sites", F.hll_sketch_estimate("sketch")).where(F.col("sites") >= F.floor(F.lit(low)))
    spread = stored(spread.select("line", "sites", "first"), "line-spread")
    near = spread.where(F.col("sites") <= F.ceil(F.lit(high))).select("line")
    exact = (_lines(docs).select("line", "site").join(sized(near, ["line"], 16 << 20), "line", "left_semi")
             .distinct().groupBy("line").agg(F.count("*").alias("exact")))
    return (spread.join(exact, "line", "left").where(F.coalesce("exact", "sites") >= min_sites)
            .select("line", "first.id", "first.at"))


def clean_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source",
                min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with cleaned texts, and ``n_lines``, ``n_removed`` before and of the removal."""
    slim = docs.select(known_id(id_column).alias("id"), F.coalesce(site_column, F.lit("")).alias("site"),
                       F.col(text_column).alias("text"))
    found = stored(boilerplate(slim, min_sites), "line-boilerplate")
    known = found.select("line", F.col("id").alias("first_id"), F.col("at").alias("first_at"))
    hits = (_lines(slim).join(sized(known, ["line", "first_id", "first_at"], 16 << 20), "line")
            .groupBy("id").agg(F.collect_set(F.struct(
                "line", F.when(F.col("first_id") == F.col("id"), F.col("first_at")).alias("keep"))).alias("bad")))
    key, bad = free_name(docs, "_dedup_id"), free_name(docs, "_dedup_bad")
    hits = stored(hits.select(F.col("id").alias(key), F.col("bad").alias(bad)), "line-hits")
    size = hits.agg(F.coalesce(F.sum(F.lit(48) + 32 * F.size(bad)), F.lit(0)).alias("n")).first()["n"]
    joined = docs.withColumn(key, known_id(id_column)).join(
        F.broadcast(hits) if size <= HITS_BYTES else hits, key, "left")
    split = F.split(text_column, "\n")
    kept = F.filter(split, lambda line, i: ~F.exists(
        bad, lambda b: (b["line"] == _line_hash(line)) & (F.trim(line) != "") & ~b["keep"].eqNullSafe(i)))
    text = F.when(F.col(bad).isNull(), F.col(text_column)).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(split), F.lit(0))
    n_kept = F.when(F.col(bad).isNull(), n_lines).otherwise(F.size(kept))
    columns = [text.alias(c) if c == text_column else F.col(c) for c in docs.columns
               if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_removed"))
