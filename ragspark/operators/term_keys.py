"""Keys under which terms within an edit distance of each other meet.

Two strings within ``d`` edits share at least one of ``d + 1`` even segments of the one, shifted by
at most ``d`` in the other (partition filter, Li, Deng and Feng 2011). So the vocabulary is keyed by
its segments, the query terms by their shifted substrings, and an equi join finds every pair; each is
then checked by its true distance. Work per vocabulary term is ``d + 1`` rows, whatever its length. How
far segment ``i`` may be shifted follows from the edits that can lie left of it (``i``) and right of
it (``d - i``): if every shared segment needed more than that, another one would be shared.

Short segments are shared by many terms. So a key also holds the terms' exact length, and terms that
differ in it meet through the lengths that the query term asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed_edits(term: Column) -> Column:
    return F.when(F.length(term) < 3, 0).when(F.length(term) <= 5, 1).otherwise(2)


def _segment_start(length: Column, edits: Column, number: Column) -> Column:
    """0-based start of segment ``number`` of ``edits + 1``; the last ones are one longer."""
    count = edits + 1
    base = F.floor(length / count).cast("int")
    longer = length - base * count
    return base * number + F.greatest(F.lit(0), number - (count - longer))


def _key(field: str, piece: Column) -> Column:
    """Join key as one number. Where two keys collide, the check of the distance decides."""
    return F.xxhash64(field, "d", "len", "seg", piece)


def vocabulary_keys(vocabulary: DataFrame) -> DataFrame:
    """(field, term, key), a few rows per term of ``vocabulary(field, term)``."""
    n = F.length("term")
    # which distances a term of this length can be asked for: exact, one edit, two edits
    asked = F.array_compact(F.array(
        F.when(n < 3, F.lit(0)), F.when((n >= 2) & (n <= 6), F.lit(1)), F.when(n >= 4, F.lit(2))))
    start = _segment_start(F.col("len"), F.col("d"), F.col("seg"))
    stop = _segment_start(F.col("len"), F.col("d"), F.col("seg") + 1)
    return (vocabulary
            .select("field", "term", n.alias("len"), F.explode(asked).alias("d"))
            .withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("d"))))
            .select("field", "term", _key("field", F.substring(F.col("term"), start + 1, stop - start)).alias("key")))


def probe_keys(wanted: DataFrame) -> DataFrame:
    """(query_field, query_term, d, key): every place a segment may sit in a query term."""
    n = F.length("query_term")
    start = _segment_start(F.col("len"), F.col("d"), F.col("seg"))
    size = _segment_start(F.col("len"), F.col("d"), F.col("seg") + 1) - start
    left, right = F.col("seg"), F.col("d") - F.col("seg")
    longer = n - F.col("len")
    first = F.greatest(start - left, start + longer - right, F.lit(0))
    last = F.least(start + left, start + longer + right, n - size)
    return (wanted
            .withColumn("d", allowed_edits(F.col("query_term")))
            .withColumn("len", F.explode(F.sequence(F.greatest(n - F.col("d"), F.lit(1)), n + F.col("d"))))
            .withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("d"))))
            .withColumns({"size": size, "first": first, "last": last})
            .where("first <= last")
            .withColumn("at", F.explode(F.sequence("first", "last")))
            .select(F.col("field").alias("query_field"), "query_term", "d",
                    _key("field", F.substring(F.col("query_term"), F.col("at") + 1, F.col("size"))).alias("key"))
            .distinct())


def key_part(parts: int) -> Column:
    return F.pmod("key", F.lit(parts)).cast("int")
