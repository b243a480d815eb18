"""Fuzzy terms: expansion of query terms to vocabulary terms within an edit distance.

The vocabulary's segment keys (``term_keys``) are stored with the index, by hashed key: a search
reads the parts its own keys fall into and shuffles no vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut, fits_broadcast, parallel, sized
from .lexical_index import LexicalIndex
from .lexical_search import FIELD_WEIGHTS, PAGE_SIZE, question_terms, rank_articles, weigh_terms
from .term_keys import key_part, probe_keys, vocabulary_keys

# A limit on the terms of one expansion is a setting; by default all near terms count.
MAX_EXPANSIONS = None
# Probe keys that are looked at on the driver to name the parts they fall into.
PROBE_BYTES = 4 * 1024 * 1024


def near_terms(wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """(field, query_term, term, distance) of ``wanted(field, query_term)`` among keyed terms."""
    distance = F.levenshtein("query_term", "term", 2)
    # -1 stands for more than 2 edits; as two bits it is 3, above any allowed number
    close = (F.col("field") == F.col("query_field")) & (distance.bitwiseAND(F.lit(3)) <= F.col("d"))
    return (keys.select("field", "term", "key").join(wanted, "key").where(close)
            .select("field", "query_term", "term").distinct().withColumn("distance", distance))


def _limited(near: DataFrame, max_expansions: int | None) -> DataFrame:
    if max_expansions is None:
        return near
    order = W.partitionBy("field", "query_term").orderBy("distance", F.col("df").desc(), "term")
    return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_expansions).drop("nth")


def expand_terms(wanted: DataFrame, vocabulary: DataFrame,
                 max_expansions: int | None = MAX_EXPANSIONS) -> DataFrame:
    """(field, query_term, term, distance, df) for distinct ``wanted(field, query_term)`` in a
    vocabulary (field, term, df) without stored keys."""
    probes = probe_keys(wanted.distinct())
    if fits_broadcast(wanted, ["field", "query_term"], limit=256 * 1024):
        probes = F.broadcast(probes)  # at most 19 keys a term
    # vocabulary rows are few bytes but many comparisons; apart, terms of one stem also part
    spread = vocabulary.repartition(parallel(vocabulary.sparkSession), "field", "term")
    near = near_terms(probes, vocabulary_keys(spread))
    return _limited(near.join(vocabulary.select("field", "term", "df"), ["field", "term"]), max_expansions)


def expand_in_index(wanted: DataFrame, index: LexicalIndex, max_expansions: int | None = MAX_EXPANSIONS) -> DataFrame:
    """(field, query_term, term, distance, df) from the index's stored keys, read in place."""
    probes = cut(probe_keys(wanted.distinct()))
    if not fits_broadcast(probes, ["query_field", "query_term", "key"], limit=PROBE_BYTES):
        found = [near_terms(probes, keys) for keys, _ in index.term_keys]
    else:
        found = []
        for keys, parts in index.term_keys:
            hit = sorted(r["part"] for r in probes.select(key_part(parts).alias("part")).distinct().collect())  # at most parts
            read = keys if len(hit) == parts else keys.where(F.col("part").isin(hit))
            found.append(near_terms(F.broadcast(probes), read))
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    near = cut(near.distinct())
    known = index.doc_freq.select("field", "term", "df").join(sized(near, ["field", "query_term", "term"]), ["field", "term"])
    return _limited(known.select("field", "query_term", "term", "distance", "df"), max_expansions)


def fuzzy_terms(questions: DataFrame, index: LexicalIndex, fields,
                max_expansions: int | None = MAX_EXPANSIONS) -> DataFrame:
    """(qid, field, term): vocabulary terms near a question's terms, each once."""
    asked = cut(question_terms(questions, fields).withColumnRenamed("term", "query_term"))
    wanted = asked.select("field", "query_term").distinct()
    if index.term_keys:
        near = expand_in_index(wanted, index, max_expansions)
    else:
        near = expand_terms(wanted, index.doc_freq.where(F.col("field").isin(list(fields))), max_expansions)
    return asked.join(near, ["field", "query_term"]).select("qid", "field", "term").distinct()


def fuzzy_match(questions: DataFrame, index: LexicalIndex, field: str = "text", k: int = PAGE_SIZE,
                max_expansions: int | None = MAX_EXPANSIONS, **how) -> DataFrame:
    """Fuzzy search of one field."""
    terms = fuzzy_terms(questions, index, (field,), max_expansions)
    return rank_articles(cut(weigh_terms(terms, index, {field: 1.0})), index, k, **how)


def bool_should(questions: DataFrame, index: LexicalIndex, weights=None, k: int = PAGE_SIZE,
                max_expansions: int | None = MAX_EXPANSIONS, **how) -> DataFrame:
    """Fuzzy search of several fields, their weighted scores added."""
    weights = weights or FIELD_WEIGHTS
    terms = fuzzy_terms(questions, index, tuple(weights), max_expansions)
    return rank_articles(cut(weigh_terms(terms, index, weights, additive=True)), index, k, **how)
