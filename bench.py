"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores. Index tables
are built once and timed on their own, as ``build_*``: searches are meant to run on a stored
index. Every result is computed in full and discarded.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ragspark.registry import queries as registered  # noqa: E402
from ragspark.session import build_session  # noqa: E402

HEADLINES = [
    "lexical_top2", "multi_match", "match_text", "lexical_retrieve", "fuzzy_match", "bool_should_fuzzy",
    "tokenize", "split_paragraphs", "truncate_text", "render_retrieval_prompt", "render_chat",
    "parse_questions", "calibrate_int8", "quantize_int8", "knn_int8", "knn_lsh", "knn_ivf", "knn_self_check", "embed_hashed",
    "semantic_retrieve", "paragraph_to_text", "build_context", "answer_questions", "run_eval", "icontains",
    "upsert_articles", "union_shards", "stream_questions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="16g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name, work):
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)

    def drained(name):
        registered.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("sum(id)").collect()  # the session itself is not measured
    timed("build_text_index", lambda: registered.text_index(spark, folder))
    timed("build_paragraph_vectors", lambda: registered.paragraph_vectors(spark, folder))
    timed("build_vector_index", lambda: registered.vector_index_tables(spark, folder))
    for name in HEADLINES:
        timed(name, lambda: drained(name))
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
