"""The answering chain, evaluation and the question stream."""

import pytest
from pyspark.sql import functions as F

from ragspark.functions import encoders, prompts
from ragspark.functions.generation import generate
from ragspark.functions.prompts import PromptVariant
from ragspark.operators import contexts, lexical_index, lexical_search, paragraphs, quantize
from ragspark.plans import answering, evaluation, question_sets, reading
from ragspark.sources import tables
from ragspark.streaming import questions as stream

TEXTS = [("Charcoal", "Charcoal is made in a kiln.\n\nRetorts make it too."),
         ("Anarchy", "Anarchy is a form of society.\n\nIts name comes from αναρχία."),
         ("Alabama", "Alabama was admitted on December 14, 1819.\n\nIt is a state.")]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    articles = spark.createDataFrame([(str(i), i, t, x) for i, (t, x) in enumerate(TEXTS)],
                                     "article_id STRING, article_seq BIGINT, title STRING, text STRING")
    home = str(tmp_path_factory.mktemp("world"))
    lexical = lexical_index.save_index(articles, home + "/lex", parts=2)
    floats = encoders.embed(paragraphs.split_paragraphs(articles), "paragraph_id", "paragraph")
    tables.write_table(floats, home + "/floats")
    vectors, ranges = quantize.save_vector_index(spark.read.parquet(home + "/floats"), home + "/vec")
    return articles, lexical, answering.VectorIndex(vectors, ranges, articles)


def _asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid STRING, question STRING")


def test_semantic_search_finds_paragraphs(spark, world):
    hits = answering.semantic_retrieve(_asked(spark, "charcoal made in a kiln", "zzz"), world[2], 2)
    got = {(r.qid, r["rank"]): r for r in hits.collect()}
    assert got["q0", 1].paragraph_id == "0.0" and got["q0", 1].page_content.text == "Charcoal is made in a kiln."
    assert ("q1", 2) in got


def copying(tokens="<|end|>", chars=200):
    """Factory of a model that copies: keywords from the question, answers from the context."""
    def one(prompt):
        for head in (prompts.PromptSet().context[0], prompts.PromptSet().answer[0]):
            if prompt.startswith(head):
                return prompt[len(head):len(head) + chars].split(tokens, 1)[0]
        return prompt.rsplit("<|user|>\n", 1)[-1].split(tokens, 1)[0]
    return lambda sampling: lambda batch: batch.map(one)


def _chain(world, factory=None, **how):
    _, lexical, semantic = world
    return lambda asked: answering.answer_questions(
        asked, answering.lexical_retriever(lexical), answering.semantic_retriever(semantic), factory or copying(), **how)


def test_chain(spark, world, tmp_path):
    asked = _asked(spark, "Where is charcoal made?", "nothing known", None)
    # the sink runs the chain once and reads back
    rows = {r.qid: r for r in answering.write_answers(_chain(world)(asked), str(tmp_path / "answers")).collect()}
    assert rows["q0"].lexical_answer.startswith("Charcoal\nCharcoal is made in a kiln.")
    assert rows["q0"].output == "Answer:\n " + rows["q0"].combined_answer
    assert rows["q1"].lexical_answer == ""            # no hits, empty context
    assert set(rows) == {"q0", "q1", "q2"}


def test_a_model_is_needed(spark, world):
    with pytest.raises(TypeError):
        answering.answer_questions(_asked(spark, "x"), answering.lexical_retriever(world[1]), lambda q: q)


def test_equal_prompts_are_generated_once_and_models_follow_the_variant(spark, tmp_path):
    log = str(tmp_path / "log")

    def model(name):
        def made(sampling):
            def write(batch):
                with open(f"{log}-{name}", "a") as f:
                    f.writelines(f"{p}\n" for p in batch)
                return batch.map(lambda p: f"{name} says {p}")
            return write
        return made
    rows = [(i, "same", "a" if i % 2 else "other") for i in range(90)] + [(100 + i, f"p{i}", "b") for i in range(5)] + [(200, None, "a")]
    df = spark.createDataFrame(rows, "qid INT, prompt STRING, variant STRING").repartition(7)
    got = {r.qid: r.output for r in generate(df, {n: model(n) for n in ("a", "b", "default")}, variant="variant").collect()}
    assert got[1] == "a says same" and got[2] == "default says same" and got[103] == "b says p3" and len(got) == 96
    assert open(f"{log}-a").read().count("same") == 1 and open(f"{log}-default").read().count("same") == 1


LONG = "filler words. " * 1500 + "The hidden kiln stands in Xanten. " + "more filler. " * 500


def test_a_hit_far_into_a_text_counts(spark, tmp_path):
    assert LONG.index("Xanten") > 12_000
    articles = spark.createDataFrame([("0", "Long", LONG), ("1", "Other", "Nothing. A kiln?")],
                                     "article_id STRING, title STRING, text STRING")
    index = lexical_index.save_index(articles, str(tmp_path / "lex"))
    hits = lexical_search.lexical_retrieve(_asked(spark, "hidden kiln stands"), index)
    context = contexts.build_context(hits, contexts.article_body()).first().context
    assert "Xanten" in context
    windows = contexts.context_windows(hits, contexts.article_body(), 300, 20).where("rank = 1").orderBy("window_no").collect()
    text, first = windows[0].context, "Long\n" + LONG
    for w in windows[1:]:
        text += "".join(" " + p for p in w.context.split(" ")[20:])
    assert text == first and all(len(w.context.split(" ")) <= 300 for w in windows)
    best = reading.best_spans(_asked(spark, "hidden kiln stands"), hits, index).first()
    assert best.span == "The hidden kiln stands in Xanten" and best["rank"] == 1
    retriever = answering.lexical_retriever(index)
    answers = answering.answer_questions(_asked(spark, "hidden kiln stands"), retriever, retriever, copying(chars=100_000)).first()
    assert "Xanten" in answers.output


def test_reading(spark, world):
    _, lexical, semantic = world
    asked = _asked(spark, "When was Alabama admitted?", "unknownword", None, "When was Alabama admitted?")
    rows = {r.qid: r for r in reading.read_answers(asked, lexical, semantic).collect()}
    assert rows["q0"].lexical_answer == "Alabama was admitted on December 14, 1819" == rows["q3"].combined_answer
    assert rows["q0"].output == "Answer:\n Alabama was admitted on December 14, 1819"
    assert rows["q1"].combined_answer == "" and set(rows) == {"q0", "q1", "q2", "q3"}
    words = {r.qid: r.question for r in reading.keywords(asked, lexical, 2).collect()}
    assert words["q0"] == words["q3"] and set(words["q0"].split(", ")) < {"was", "alabama", "admitted"}


def test_cases_and_containment(spark):
    questions = spark.createDataFrame([("1", "w?", "αναρχία"), ("2", "x?", "KILN"), ("3", "y?", "no")],
                                      "qid STRING, question STRING, answer STRING")
    outputs = spark.createDataFrame([("1", "from ΑΝΑΡΧΊΑ"), ("2", "a kiln")], "qid STRING, output STRING")
    scored = evaluation.score_cases(evaluation.eval_cases(questions), outputs)
    assert {r.qid: r["pass"] for r in scored.collect()} == {"1": True, "2": True, "3": False}


def test_eval_cases_round_trip(spark, tmp_path):
    questions = spark.createDataFrame([("1", "Nicomachus; thirteen?", "ada")], "qid STRING, question STRING, answer STRING")
    evaluation.write_cases(evaluation.eval_cases(questions), str(tmp_path / "c"))
    row = evaluation.read_cases(spark, str(tmp_path / "c")).first()
    assert row.vars.inquiry == "Nicomachus; thirteen?" and [(a.type, a.value) for a in row["assert"]] == [("icontains", "ada")]


def test_eval_under_variants(spark, world):
    _, lexical, semantic = world
    questions = spark.createDataFrame([("a", "When was Alabama admitted?", "december 14, 1819"),
                                       ("b", "Charcoal kiln", "submarine")], "qid STRING, question STRING, answer STRING")
    cases = evaluation.eval_cases(questions)
    mute = PromptVariant("mute", "context", ("Say nothing of ", "\n<|user|>\n", "<|end|>"))
    silent = lambda sampling: lambda batch: batch.map(lambda p: "")
    chain = _chain(world, {"default": copying(), "silent": silent}, variants=[mute])
    runs = evaluation.run_eval(cases, chain, ["mute", "silent"])
    got = {(r.variant, r.qid): r["pass"] for r in runs.collect()}
    assert got == {("default", "a"): True, ("default", "b"): False, ("mute", "a"): False, ("mute", "b"): False,
                   ("silent", "a"): False, ("silent", "b"): False}
    rates = {r.variant: (r.cases, r.passed, r.rate) for r in evaluation.pass_rate(runs).collect()}
    assert rates == {"default": (2, 1, 0.5), "mute": (2, 0, 0.0), "silent": (2, 0, 0.0)}
    readers = (reading.Reader(), reading.Reader("one word", keywords=1, articles=1, paragraphs=1))
    read = evaluation.run_eval(cases, lambda asked: reading.read_answers(asked, lexical, semantic, readers), ["one word"])
    assert {(r.variant, r.qid): r["pass"] for r in read.collect()} == {
        ("default", "a"): True, ("default", "b"): False, ("one word", "a"): True, ("one word", "b"): False}


def test_question_sets(spark, world):
    def writer(sampling):
        assert sampling.context_tokens == 16384
        return lambda prompts: prompts.map(
            lambda p: 'Sure:\n["question": "q1", "answer": "%s"],\n{"article_id": 5, "question": "q2"}' % ("kiln" in p))
    facts = question_sets.retrieval_questions(world[0], writer, n=2)
    got = {(r.source_article_id, r.line_no): (r.article_id, r.question, r.answer) for r in facts.collect()}
    assert got == {("0", 1): (None, "q1", "True"), ("0", 2): ("5", "q2", None),
                   ("1", 1): (None, "q1", "False"), ("1", 2): ("5", "q2", None)}
    assert question_sets.essay_questions(world[0], writer).count() == 6
    # every window of a long article has a prompt
    long = world[0].limit(1).withColumn("text", F.lit("word " * 7000))
    assert question_sets.retrieval_questions(long, writer).select("window_no").distinct().count() == 3


def test_question_sets_from_the_articles(spark, world):
    index = world[1]
    made = {r.article_id: (r.question, r.answer) for r in question_sets.cloze_questions(index.articles, index).collect()}
    assert len(made) == 3 and all(q.count("____") and a not in q.split() for q, a in made.values())
    assert made["2"][1] in TEXTS[2][1].lower()
    essays = {r.article_id: r.question for r in question_sets.topic_questions(index.articles, index).collect()}
    assert essays["1"].endswith(" belong together in Anarchy?") and essays["1"].count(",") == 2


def test_telling_terms_spread_with_the_postings(spark, world, monkeypatch):
    """Tasks follow the counted postings, not the session's partitions, and the words stay the same."""
    index = world[1]

    def told():
        found = question_sets.telling_terms(index, 3)
        return found.rdd.getNumPartitions(), sorted(map(tuple, found.collect()))
    held = index.postings.where("field = 'text'").count()
    _, usual = told()
    monkeypatch.setattr(question_sets, "TASK_POSTINGS", 1, raising=False)
    tasks, few = told()
    assert tasks == held > 8 and few == usual
    monkeypatch.setattr(question_sets, "fits_broadcast", lambda *_: False, raising=False)
    assert told() == (held, usual)


def test_stream_equals_batch_and_resumes(spark, world, tmp_path):
    _, lexical, _ = world
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def search(batch):
        return lexical_search.multi_match(batch, lexical, k=2)

    def drain():
        source = stream.question_stream(spark, inbox, "qid STRING, question STRING", files_per_batch=1)
        stream.answer_stream(source, search, out, mark).awaitTermination()

    first, second = _asked(spark, "charcoal kiln", "state of society"), _asked(spark, "x", "y", "Alabama, anarchy").where("qid = 'q2'")
    first.repartition(2).write.parquet(inbox)
    drain()
    assert sorted(stream.read_answers(spark, out).collect()) == sorted(search(first).collect())
    second.write.mode("append").parquet(inbox)
    drain()     # picks up only what is new
    both = first.unionByName(second)
    assert sorted(stream.read_answers(spark, out).collect()) == sorted(search(both).collect())


def test_replayed_batch_overwrites_itself(spark, world, tmp_path):
    _, lexical, _ = world
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    _asked(spark, "charcoal").write.parquet(inbox)
    for run in range(2):    # a lost checkpoint replays batch 0 into the same table
        source = stream.question_stream(spark, inbox, "qid STRING, question STRING")
        stream.answer_stream(source, lambda b: lexical_search.multi_match(b, lexical, k=2), out,
                             str(tmp_path / f"mark{run}")).awaitTermination()
    assert stream.read_answers(spark, out).count() == 1


def test_known_questions_are_answered_from_state(spark, tmp_path):
    articles = spark.createDataFrame([(str(i), t, x) for i, (t, x) in enumerate(TEXTS)], "article_id STRING, title STRING, text STRING")
    home, inbox, out, state, mark = (str(tmp_path / n) for n in ("ix", "in", "out", "state", "mark"))
    lexical_index.save_index(articles, home)
    searched = []

    def current():
        index = lexical_index.load_index(spark, home)

        def search(batch):
            searched.append({r.question for r in batch.collect()})
            return lexical_search.multi_match(batch, index, k=2)
        return str(index.version), search

    def ask(*rows, mark=mark, **how):
        spark.createDataFrame(rows, "qid STRING, question STRING").coalesce(1).write.mode("append").parquet(inbox)
        source = stream.question_stream(spark, inbox, "qid STRING, question STRING", files_per_batch=1)
        stream.remembering_stream(source, current, out, state, mark, **how).awaitTermination()
        return {(r.qid, r.article_id) for r in stream.read_answers(spark, out).collect()}
    got = ask(("a", "charcoal kiln"), ("b", "charcoal kiln"), ("c", "zzz"), ("d", None))
    assert got == {("a", "0"), ("b", "0")} and searched == [{"charcoal kiln", "zzz"}]
    got = ask(("e", "charcoal kiln"), ("f", "zzz"), ("g", "Alabama"))
    assert ("e", "0") in got and ("g", "2") in got and searched[1:] == [{"Alabama"}]
    # a new index version lets old answers expire
    more = spark.createDataFrame([("9", "Zzz", "zzz charcoal kiln")], "article_id STRING, title STRING, text STRING")
    lexical_index.update_index(spark, home, more)
    got = ask(("h", "zzz"), ("i", "Alabama"))
    assert ("h", "9") in got and searched[2:] == [{"zzz", "Alabama"}]
    # a replay of all batches from nothing but the inbox gives the same rows for the same index
    before = sorted(map(tuple, spark.read.parquet(out).where("batch_id = 2").collect()))
    source = stream.question_stream(spark, inbox, "qid STRING, question STRING", files_per_batch=1)
    stream.remembering_stream(source, current, out, state, str(tmp_path / "again")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).where("batch_id = 2").collect())) == before


def test_whole_chain_runs_on_a_stream(spark, world, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    _asked(spark, "Where is charcoal made?").write.parquet(inbox)
    source = stream.question_stream(spark, inbox, "qid STRING, question STRING")
    stream.answer_stream(source, _chain(world), out, str(tmp_path / "mark")).awaitTermination()
    assert stream.read_answers(spark, out).first().output.startswith("Answer:\n Charcoal")


@pytest.mark.parametrize("files", [1, 3])
def test_stream_reads_one_table_of_a_folder(spark, tmp_path, files):
    table, out = str(tmp_path / "in" / "asked.parquet"), str(tmp_path / "out")
    asked = spark.createDataFrame([("1", "charcoal"), ("2", "harbour")], "qid STRING, question STRING").repartition(files)
    asked.write.parquet(table)
    asked.write.parquet(str(tmp_path / "in" / "other.parquet"))
    if files == 1:  # the table is one file
        table = next(str(f) for f in (tmp_path / "in" / "asked.parquet").iterdir() if f.suffix == ".parquet")
    source = stream.question_stream(spark, table, "qid STRING, question STRING")
    stream.answer_stream(source, lambda b: b.select("qid"), out, str(tmp_path / "mark")).awaitTermination()
    assert sorted(r.qid for r in stream.read_answers(spark, out).collect()) == ["1", "2"]


def test_answers_of_an_empty_stream(spark, tmp_path):
    assert stream.read_answers(spark, str(tmp_path / "none"), "qid STRING").count() == 0
