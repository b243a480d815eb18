"""Keyword search against a plain Python computation, and its strategies against each other."""

import inspect
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragspark.operators import fuzzy, lexical_index, lexical_search


def _tokens(s):
    return [t for t in re.split(r"[^\w]+|_", s.lower()) if t]


def _brute(docs, question, weights, k, additive=False, terms=None):
    scores = {}
    for field, weight in weights.items():
        toks = {d: _tokens(row[field]) for d, row in docs.items()}
        lengths = {d: len(t) for d, t in toks.items() if t}
        avgdl, n = sum(lengths.values()) / len(lengths), len(lengths)
        wanted = set(_tokens(question)) if terms is None else terms[field]
        for term in wanted:
            df = sum(term in t for t in toks.values())
            for d, t in toks.items():
                tf = Counter(t)[term]
                if tf:
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    s = weight * idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
                    scores.setdefault(d, {}).setdefault(field, 0.0)
                    scores[d][field] += s
    combine = sum if additive else max
    final = {d: round(combine(f.values()), 6) for d, f in scores.items()}
    return sorted(final.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words = [a + b for a in "banokitelu" for b in ("", "ra", "sti", "mo", "xx")] + ["the"] * 30
    docs = {i: {"title": " ".join(rng.choices(words, k=3)), "text": " ".join(rng.choices(words, k=rng.randint(1, 60)))}
            for i in range(300)}
    docs[300] = {"title": "onlytitle", "text": "nothing here"}
    docs[301] = {"title": "plain", "text": "onlytext and inboth"}
    docs[302] = {"title": "inboth", "text": "something"}
    docs[303] = docs[304] = {"title": "twin", "text": "twinned words"}
    df = spark.createDataFrame([(i, d["title"], d["text"]) for i, d in docs.items()],
                               "article_id INT, title STRING, text STRING")
    return docs, df


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return lexical_index.save_index(corpus[1], str(tmp_path_factory.mktemp("lex")), parts=4)


QUESTIONS = ["the bara obsti", "onlytitle", "onlytext", "inboth", "unknownword", "twin", "kimo, kimo, kimo", "the",
             "lu ra the toxx nosti eara limo"]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "qid INT, question STRING")


def _by_question(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append((r.article_id, r.score))
    return out


@pytest.mark.parametrize("how", [{}, {"prune": True}, {"broadcast_limit": 0}, {"prune": True, "broadcast_limit": 0}])
def test_multi_match_equals_brute_force(corpus, index, questions, how, monkeypatch):
    # low limits make the small corpus take the paths meant for large ones
    monkeypatch.setattr(lexical_search, "SALT_POSTINGS", 20)
    monkeypatch.setattr(lexical_search, "SEED_POSTINGS", 10)
    got = _by_question(lexical_search.multi_match(questions, index, k=5, **how))
    for qid, q in enumerate(QUESTIONS):
        want = _brute(corpus[0], q, {"title": 3.0, "text": 1.0}, 5)
        assert [d for d, _ in got.get(qid, [])] == [d for d, _ in want], q
        assert [s for _, s in got.get(qid, [])] == pytest.approx([s for _, s in want], abs=2e-6)


def test_fallback_when_pruning_gains_nothing(index, questions, monkeypatch):
    monkeypatch.setattr(lexical_search, "PRUNE_ABOVE_PAIRS", 0)
    assert _by_question(lexical_search.multi_match(questions, index)) == _by_question(
        lexical_search.multi_match(questions, index, prune=False))


def test_single_field_and_title_weight(corpus, index, questions):
    got = _by_question(lexical_search.match_text(questions, index, k=3))
    assert 1 not in got and got[2][0][0] == 301
    both = _by_question(lexical_search.multi_match(questions, index))
    assert [d for d, _ in both[3]] == [302, 301]       # title weighs more
    assert [d for d, _ in both[5]][:2] == [303, 304]   # equal scores: lower id first
    assert 4 not in both                               # unknown word: no hit


def test_retriever_carries_content(index, questions):
    rows = [r for r in lexical_search.lexical_retrieve(questions, index).collect() if r.qid == 1]
    assert rows[0].page_content.title == "onlytitle" and rows[0].page_content.text == "nothing here"


def test_unsaved_index_is_the_same(corpus, index, questions):
    plain = lexical_index.build_index(corpus[1])
    assert _by_question(lexical_search.multi_match(questions, plain)) == _by_question(
        lexical_search.multi_match(questions, index))


def test_second_build_leaves_index_alone(spark, corpus, index, tmp_path):
    path = str(tmp_path / "ix")
    lexical_index.save_index(corpus[1], path, parts=2)
    again = lexical_index.save_index(corpus[1].limit(1), path, parts=2)
    assert again.articles.count() == 305
    replaced = lexical_index.save_index(corpus[1].limit(1), path, mode="overwrite", parts=2)
    assert replaced.articles.count() == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_reads_only_the_parts_of_its_terms(spark, corpus, tmp_path):
    index = lexical_index.save_index(corpus[1], str(tmp_path / "ix"), parts=64)
    one = spark.createDataFrame([(1, "onlytext inboth")], "qid INT, question STRING")
    plan = _plan(lexical_search.multi_match(one, index, k=2))
    assert "PartitionFilters: [part" in plan and "WindowGroupLimit" in plan
    # postings by article, best rows by question
    assert plan.count("Exchange hashpartitioning") == 2


def test_blocks_are_skipped_without_a_change_of_the_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK", 4)
    monkeypatch.setattr(lexical_search, "BLOCK", 4)
    rng = random.Random(2)
    rows = [(i, f"t{i % 50}", " ".join(["the", "of"] * rng.randint(1, 3) + [f"w{rng.randint(0, 300)}" for _ in range(8)]))
            for i in range(800)]
    index = lexical_index.save_index(spark.createDataFrame(rows, "article_id INT, title STRING, text STRING"), str(tmp_path / "ix"))
    asked = spark.createDataFrame([(i, f"the of w{i} w{i + 1} w{i + 2}") for i in range(0, 30, 5)], "qid INT, question STRING")
    assert _by_question(lexical_search.multi_match(asked, index, k=2, prune=True)) == _by_question(
        lexical_search.multi_match(asked, index, k=2, prune=False))
    weights = lexical_search.FIELD_WEIGHTS
    terms = lexical_search.weigh_terms(lexical_search.question_terms(asked.where("qid = 5")), index, weights)
    counts = lexical_search.block_counts(terms, index, 2, len(weights))
    assert 0 < counts["deciding"] < 0.5 * counts["all"] and counts["last"] < 0.7 * counts["all"]


def _tables(index):
    return [sorted(map(tuple, df.collect())) for df in (
        index.articles.select("article_id", "title", "text"), index.doc_freq.select("field", "term", "df"),
        index.postings, index.stats.selectExpr("field", "n", "round(avgdl, 9)"))]


def test_updated_index_equals_a_new_one(spark, corpus, questions, tmp_path):
    docs, df = corpus
    path = str(tmp_path / "ix")
    lexical_index.save_index(df.where("article_id % 3 <> 1").selectExpr(
        "article_id", "title", "if(article_id % 4 = 0, concat(text, ' the lu outdated'), text) AS text"), path, parts=8)
    lexical_index.update_index(spark, path, df.where("article_id % 3 = 1 OR article_id % 4 = 0"))
    gone = spark.createDataFrame([(5,), (304,), (9999,)], "article_id INT")
    again = df.where("article_id = 7")
    updated = lexical_index.update_index(spark, path, again.unionByName(again), gone)
    final = df.where("article_id NOT IN (5, 304)")
    fresh = lexical_index.save_index(final, str(tmp_path / "fresh"))
    assert len(updated.segments) == 3
    for got, want in zip(_tables(updated), _tables(fresh)):
        assert got == want
    want = _by_question(lexical_search.multi_match(questions, fresh, k=5))
    for how in ({}, {"prune": True}, {"broadcast_limit": 0}):
        assert _by_question(lexical_search.multi_match(questions, updated, k=5, **how)) == want
    near = [_by_question(fuzzy.fuzzy_match(questions, ix, k=4)) for ix in (fresh, updated, lexical_index.build_index(final))]
    assert near[0] == near[1] == near[2]
    merged = lexical_index.merge_index(spark, path)
    assert len(merged.segments) == 1 and _tables(merged) == _tables(fresh)
    assert _by_question(lexical_search.multi_match(questions, merged, k=5)) == want
    # an older version is still there to be read
    assert len(lexical_index.load_index(spark, path, 2).segments) == 2
    only = lexical_index.update_index(spark, path, df.where("false"), gone.limit(1))
    assert _tables(only) == _tables(fresh)


def test_killed_overwrite_leaves_the_old_version(spark, corpus, tmp_path, monkeypatch):
    path = str(tmp_path / "ix")
    lexical_index.save_index(corpus[1], path)

    def killed(*_):
        raise RuntimeError("killed")
    with monkeypatch.context() as m:
        m.setattr(lexical_index, "_write_terms", killed)
        with pytest.raises(RuntimeError):
            lexical_index.save_index(corpus[1].limit(1), path, mode="overwrite")
        with pytest.raises(RuntimeError):
            lexical_index.update_index(spark, path, corpus[1].limit(1))
    assert lexical_index.versions(spark, path) == [1]
    assert lexical_index.load_index(spark, path).articles.count() == 305
    # so does one that dies while its version is written; the next one takes another number
    (tmp_path / "ix" / "versions" / "2").mkdir()
    assert lexical_index.load_index(spark, path).version == 1
    assert lexical_index.save_index(corpus[1].limit(1), path, mode="overwrite").version == 3


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def _allowed(t):
    return 0 if len(t) < 3 else 1 if len(t) <= 5 else 2


def test_expansion_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = {"".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(1500)}
    wanted = {"".join(rng.choices("abcé", k=n)) for n in range(1, 13) for _ in range(6)}
    voc = spark.createDataFrame([("text", t, 1) for t in vocabulary], "field STRING, term STRING, df BIGINT")
    ask = spark.createDataFrame([("text", t) for t in wanted], "field STRING, query_term STRING")
    got = {(r.query_term, r.term, r.distance) for r in fuzzy.expand_terms(ask, voc, None).collect()}
    want = {(q, t, _edits(q, t)) for q in wanted for t in vocabulary if _edits(q, t) <= _allowed(q)}
    assert got == want


def test_stored_keys_are_read_by_part(spark, corpus, tmp_path):
    index = lexical_index.save_index(corpus[1], str(tmp_path / "ix"), parts=64)
    asked = spark.createDataFrame([("text", "onlytexd"), ("title", "obsti")], "field STRING, query_term STRING")
    got = {(r.field, r.query_term, r.term) for r in fuzzy.expand_in_index(asked, index).collect()}
    vocabulary = index.doc_freq.select("field", "term").collect()
    assert got == {(f, q, t) for f, q in (("text", "onlytexd"), ("title", "obsti")) for g, t in vocabulary
                   if f == g and _edits(q, t) <= _allowed(q)}


def test_expansion_order_and_limit(spark):
    voc = spark.createDataFrame([("text", t, d) for t, d in (("cart", 5), ("card", 9), ("care", 9), ("carts", 50))],
                                "field STRING, term STRING, df BIGINT")
    ask = spark.createDataFrame([("text", "cart")], "field STRING, query_term STRING")
    got = {r.term for r in fuzzy.expand_terms(ask, voc, 3).collect()}
    assert got == {"cart", "carts", "card"}  # distance, then df, then term


@pytest.mark.parametrize("how", [{}, {"prune": True}])
def test_fuzzy_searches_equal_brute_force(corpus, index, spark, how):
    texts = ["onlytitel", "xobsti twinn", "tha"]
    asked = spark.createDataFrame(list(enumerate(texts)), "qid INT, question STRING")
    docs = corpus[0]
    fields = {f: {t for d in docs.values() for t in _tokens(d[f])} for f in ("title", "text")}
    added = _by_question(fuzzy.bool_should(asked, index, k=5, max_expansions=None, **how))
    single = _by_question(fuzzy.fuzzy_match(asked, index, k=5, max_expansions=None, **how))
    for qid, q in enumerate(texts):
        near = {f: {t for w in _tokens(q) for t in fields[f] if _edits(w, t) <= _allowed(w)} for f in fields}
        want = _brute(docs, q, {"title": 3.0, "text": 1.0}, 5, additive=True, terms=near)
        assert [d for d, _ in added.get(qid, [])] == [d for d, _ in want]
        want = _brute(docs, q, {"text": 1.0}, 5, terms=near)
        assert [d for d, _ in single.get(qid, [])] == [d for d, _ in want]


@pytest.mark.parametrize("kind", ["BIGINT", "STRING"])
def test_many_terms_are_searched_in_passes(spark, index, monkeypatch, kind):
    asked = spark.createDataFrame([(i, QUESTIONS[i % len(QUESTIONS)]) for i in range(200)], "qid BIGINT, question STRING")
    asked = asked.withColumn("qid", asked.qid.cast(kind))
    want = _by_question(lexical_search.multi_match(asked, index, k=2))

    def joined(*_):
        raise AssertionError("terms and postings were joined")
    monkeypatch.setattr(lexical_search, "_match", joined)
    assert want and _by_question(lexical_search.multi_match(asked, index, k=2, broadcast_limit=40_000)) == want


def test_parts_follow_the_text(spark, corpus, monkeypatch):
    assert lexical_index.PART_BYTES <= 16 << 20 and lexical_index.SLICE_ARTICLES <= 1_000_000
    monkeypatch.setattr(lexical_index, "PART_BYTES", 100)
    parts, slices, _ = lexical_index._layout(corpus[1], ("title", "text"), None)
    assert parts > lexical_index.LEAST_PARTS and slices == 1


def test_terms_are_not_gathered_in_one_task(spark, index, questions):
    terms = lexical_search.weigh_terms(lexical_search.question_terms(questions), index, lexical_search.FIELD_WEIGHTS).cache()
    held = lexical_search._fetched(terms, 1 << 20)
    assert held.num_rows == terms.count() and lexical_search._fetched(terms, 128) is None
    assert "limit(" not in inspect.getsource(lexical_search._fetched)


def test_runs_hold_the_postings_and_give_the_same_blocks(spark, corpus):
    """Postings travel as one row for each task and term; equal ids with equal lengths are added up."""
    extra = spark.createDataFrame([("x", "one two", "a b b"), ("x", "one two", "b c c"), ("x", None, "a"), ("y", "", None)],
                                  "article_id STRING, title STRING, text STRING")
    for articles in (corpus[1].select("article_id", "title", "text"), extra):
        for slices in (1, 3):
            runs = lexical_index.posting_runs(articles.repartition(3, "article_id"), slices=slices)
            rows = lexical_index.postings(articles)
            flat = runs.select("field", "term", F.inline(F.arrays_zip("article_id", "dl", "tf")))
            assert sorted(map(tuple, flat.collect())) == sorted(
                (r.field, r.term, r.article_id, r.dl, r.tf) for r in rows.collect())
            assert runs.count() < rows.count()
            stats = lexical_index.corpus_stats(lexical_index.field_totals(lexical_index.field_lengths(articles)))

            def told(blocks):
                return sorted((r.part, r.field, r.term, r.block, r.n, r.top, sorted(zip(r.articles, r.dls, r.tfs)))
                              for r in blocks.collect())
            got = told(lexical_index.blocks_of(runs, stats, 4, slices))
            assert got == told(lexical_index.blocks_of(rows, stats, 4, slices)) and got


def test_a_task_writes_the_blocks_of_one_part(spark, corpus):
    """Parts that were dealt by a hash met in tasks, the longest took several."""
    articles = corpus[1].select("article_id", "title", "text")
    stats = lexical_index.corpus_stats(lexical_index.field_totals(lexical_index.field_lengths(articles)))
    blocks = lexical_index.blocks_of(lexical_index.postings(articles), stats, 16, 1)
    tasks = blocks.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("part").alias("parts")).collect()
    assert {r.parts for r in tasks} == {1} and len(tasks) == blocks.select("part").distinct().count() > 4


def test_passes_go_through_postings_dealt_once(spark, corpus, tmp_path, monkeypatch):
    """Each pass read and shuffled the postings again and added up all of them for all articles."""
    docs, df = corpus
    path = str(tmp_path / "ix")
    lexical_index.save_index(df.where("article_id % 3 <> 1").selectExpr(
        "article_id", "title", "if(article_id % 4 = 0, concat(text, ' outdated'), text) AS text"), path, parts=4)
    one = lexical_index.save_index(df, str(tmp_path / "one"), parts=4)
    updated = lexical_index.update_index(spark, path, df.where("article_id % 3 = 1 OR article_id % 4 = 0"))
    # low limits make several slabs, some of them searched first
    monkeypatch.setattr(lexical_search, "SLAB_ARTICLES", 40)
    monkeypatch.setattr(lexical_search, "FIRST_SLABS", 4)
    monkeypatch.setattr(lexical_search, "FIRST_PIECES", 2)
    calls, made = [], lexical_search._slabs

    def again(*_):
        raise AssertionError("a pass dealt the postings anew")
    monkeypatch.setattr(lexical_search, "_small_search", again)
    monkeypatch.setattr(lexical_search, "_slabs", lambda *a: calls.append(made(*a)) or calls[-1])
    asked = spark.createDataFrame([(i, q) for i in range(0, 45, 9) for i, q in enumerate(QUESTIONS, i)], "qid INT, question STRING")
    for index in (one, updated):
        got = _by_question(lexical_search.multi_match(asked, index, k=5, broadcast_limit=7_000))
        for qid, q in asked.collect():
            want = _brute(docs, q, {"title": 3.0, "text": 1.0}, 5) if qid < 9 else got.get(qid - 9, [])
            assert [d for d, _ in got.get(qid, [])] == [d for d, _ in want], q
            assert [s for _, s in got.get(qid, [])] == pytest.approx([s for _, s in want], abs=2e-6)
    assert len(calls) == 2 and all(slabs.count() > early > 2 for early, slabs in calls)


@pytest.mark.parametrize("steps", [{}, {"SLAB_CELLS": 1, "SLAB_IMPACTS": 5, "SLAB_HITS": 3, "ROW_TERMS": 2}])
def test_slab_completes_what_can_reach_the_bound(monkeypatch, steps):
    """With bounds fewer impacts are added up, and the best articles stay the same."""
    for name, value in steps.items():
        monkeypatch.setattr(lexical_search, name, value)
    rng, k, n, terms = np.random.default_rng(5), 3, 60, 40
    number, article = np.nonzero(rng.random((terms, n)) < np.linspace(0.02, 0.9, terms)[:, None])
    weight = rng.integers(1, 5, len(number)) / 5  # ties among them
    row = lexical_search._slab_of(pa.table({"slab": [0], "article_id": [[f"a{x}" for x in article]], "number": [(number * 7).tolist()],
                                            "share": [weight.tolist()]}))
    dense = np.zeros((terms, n))
    dense[number, article] = weight
    table = [(q, g, int(t) * 7, float(rng.integers(1, 9))) for q in range(30) for g in (0, 1) for t in rng.choice(terms + 2, 12, False)]
    table = pa.table({name: list(c) for name, c in zip(("qid", "grp", "number", "w"), zip(*table))})
    table = table.append_column("top", pa.array(np.full(len(table), 0.8)))
    want = []
    for q in range(30):
        sums = np.zeros((2, n))
        for r in table.to_pylist():
            if r["qid"] == q and r["number"] < terms * 7:
                sums[r["grp"]] += r["w"] * dense[r["number"] // 7]
        best = sorted(((-round(x, 6), f"a{i}") for i, x in enumerate(sums.max(0)) if x), )[:k]
        want += [(q, a, -x) for x, a in best]
    asked = lexical_search._Pass(table, 2)

    def found():
        sent = asked.sent()
        slab = lexical_search._Slab(row, 0, sent)
        rows = slab.best(sent, k).to_pylist()
        return [(sent["qids"][r["q"]].as_py(), r["id"], pytest.approx(r["score"], abs=1e-6)) for r in rows], slab.count.sum()
    got, all_pairs = found()
    assert got == want
    asked.set_bounds(pa.table({"qid": [q for q, _, _ in want], "score": [s for _, _, s in want]}), k)
    got, pairs = found()
    assert got == want and pairs < 0.8 * all_pairs and not asked.decides.all()
