"""The thirteen operators bound to the test tables, and their SQL twins."""

from __future__ import annotations

from . import (byte_cnn, jaccard_join, line_dedup, nbest_pieces, passage_dedup, periodic_runs, ppm, preferences,
               simplex_kmeans, spaced_seeds, syncmers, toxicity, wordpiece_counts)
from .common import source
from .oracles import ORACLES  # noqa: F401


def op1_document_fingerprints(spark, sf_dir):
    return syncmers.fingerprints(source(spark, sf_dir))


def op2_lm_scoring(spark, sf_dir):
    return ppm.scores(source(spark, sf_dir))


def op3_preference_formatting(spark, sf_dir):
    return preferences.preference_pairs(preferences.swapped_endings(source(spark, sf_dir, "conversations")))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(source(spark, sf_dir), source(spark, sf_dir, "labels"))


def op5_substring_dedup(spark, sf_dir):
    return passage_dedup.repeated_passages(source(spark, sf_dir))


def op6_token_counts(spark, sf_dir):
    return wordpiece_counts.token_counts(source(spark, sf_dir))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.clean_lines(source(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op9_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(source(spark, sf_dir))


def op8_benchmark_decontamination(spark, sf_dir):
    return spaced_seeds.contaminated(source(spark, sf_dir), source(spark, sf_dir, "benchmark"))


def op10_sentencepiece_nbest(spark, sf_dir):
    return nbest_pieces.digests(nbest_pieces.encode(source(spark, sf_dir)))


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.digests(periodic_runs.find_runs(source(spark, sf_dir), rearrange=periodic_runs.periodic_tail))


def op12_language_id(spark, sf_dir):
    return byte_cnn.languages(source(spark, sf_dir))


def op13_centroid_clustering(spark, sf_dir):
    return simplex_kmeans.centroid_clusters(source(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_preference_formatting": op3_preference_formatting,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op10_sentencepiece_nbest": op10_sentencepiece_nbest,
    "op7_line_dedup": op7_line_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_language_id": op12_language_id,
    "op13_centroid_clustering": op13_centroid_clustering,
}
