"""The ten operators against brute force, on small tables with every awkward row."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("ragspark.llm")
from ragspark.llm import (jaccard_join, line_dedup, nbest_pieces, passage_dedup, ppm, preferences,  # noqa: E402
                          spaced_seeds, syncmers, toxicity, wordpiece_counts)

RANDOM = random.Random(3)
VOCABULARY = ["".join(RANDOM.choice("abcdefghij") for _ in range(RANDOM.randint(2, 7))) for _ in range(400)]
PROSE = [" ".join(RANDOM.choice(VOCABULARY) for _ in range(60)) for _ in range(8)]
PASSAGE = " ".join(RANDOM.choice(VOCABULARY) for _ in range(55))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, score double, part int, "
          "line string, key long, n int, block int, bad int, packed string, h int")


def _row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, 1, 7, 0.5, 3, "x", 4, 5, 6, 7, "y", 8)


def _near(text, at):
    words = text.split()
    words[at] = "changed"
    return "  ".join(words).upper()


ROWS = ([_row(i, t, f"s{i % 4}") for i, t in enumerate(PROSE)]
        + [_row(20, PROSE[0]), _row(21, _near(PROSE[0], 58)), _row(22, _near(PROSE[1], 2)), _row(22, _near(PROSE[1], 2)),
           _row(23, f"{PROSE[2]} {PASSAGE} more"), _row(24, f"{PROSE[3]} {PASSAGE}\nother end"),
           _row(30, None), _row(31, ""), _row(32, " \n\t "), _row(33, "one two"), _row(34, "ONE two"), _row(None, PROSE[4]),
           _row(None, None, None), _row(35, "word " * 30_000, None), _row(36, "é▁漢字 ².\u0000x  \U0001F600\n\n a "),
           _row(37, "x" * 50), _row(38, "spam line\nunique " + VOCABULARY[5])])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _texts():
    return [(r[0], r[1]) for r in ROWS]


def _words(text):
    return (text or "").encode().lower().split()


# --- 9 ------------------------------------------------------------------------------------------

def _jaccard(rows):
    sets = []
    for _, text in rows:
        w = _words(text)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        k = len(sets[i] & sets[j])
        if k and 100 * k >= 75 * len(sets[i] | sets[j]):
            label[top(i)] = top(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def test_jaccard_components(docs):
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted(map(tuple, got), key=str) == _jaccard(_texts())


def test_jaccard_near_copies_chain(spark):
    """Many near copies of one text, each a few edits from its neighbour, in one hot group."""
    base = [RANDOM.choice(VOCABULARY) for _ in range(120)]
    rows = []
    for i in range(60):
        base = list(base)
        base[RANDOM.randrange(120)] = f"new{i}"
        rows.append((100 - i, " ".join(base)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == _jaccard(rows)


def test_first_of_each_keeps_all_columns(docs):
    kept = jaccard_join.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {0, 1, 2, 30, 31, 32, 33, 35} <= ids and not {20, 21, 22, 34} & ids


def test_first_of_each_goes_by_id_and_text(spark):
    rows = [(1, PROSE[0], 1), (2, PROSE[0], 2), (2, PROSE[1], 3), (2, PROSE[1], 4), (None, PROSE[2], 5), (None, PROSE[0], 6),
            (None, None, 7), (3, "", 8), (3, " \n", 9), (4, _near(PROSE[0], 58), 10)]
    df = spark.createDataFrame(rows, "key long, text string, _text int").withColumnRenamed("key", "number")
    kept = jaccard_join.first_of_each(df, id_column="number")
    assert kept.columns == df.columns
    got = sorted(r["_text"] for r in kept.collect())
    assert got in ([1, 3, 5, 7, 8, 9], [1, 4, 5, 7, 8, 9])


# --- 1 ------------------------------------------------------------------------------------------

def test_fingerprints(docs):
    got = [r.asDict() for r in syncmers.fingerprints(docs).collect()]
    order = sorted(_texts(), key=lambda r: (r[0] is None, -(r[0] or 0),
                                            -int(hashlib.sha256((r[1] or "").encode()).hexdigest()[:24], 16)))
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[:len(text) - m] + after[:m]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=str) == sorted(want, key=str)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["fingerprint"] == by_id[20]["fingerprint"] and by_id[31]["fingerprint"] == ""
    assert by_id[31]["near_edited"] == 1.0 and all(0 <= r["near_next"] <= 1 for r in got)
    assert 0.3 < by_id[5]["near_edited"] < 0.8 and by_id[5]["near_next"] < 0.1


def test_fingerprints_in_many_ranges(spark, monkeypatch):
    rows = [(i * 7 % 3001, f"{PROSE[i % 8][i % 50:]} {i}") for i in range(3001)] + [(2**60, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    small = {r["doc_id"]: r for r in syncmers.fingerprints(df).collect()}
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 2_000)
    many = syncmers.fingerprints(df)
    assert many.rdd.getNumPartitions() > 400
    assert {r["doc_id"]: r for r in many.collect()} == small


def test_sketches_and_likeness_by_definition():
    k, width, ones = syncmers.K, syncmers.S, (1 << 64) - 1

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & ones
        return x ^ x >> 31

    def joined(values):
        out = 0
        for v in values:
            out = (out * 0x9E3779B97F4A7C15 + v) & ones
        return mix(out)

    def anchors(text):
        found = set()
        for i in range(len(text) - k + 1):
            inner = [joined(map(ord, text[j:j + width])) for j in range(i, i + k - width + 1)]
            if min(inner) in (inner[0], inner[-1]):
                found.add(joined(inner[j] for j in range(0, k, width)) >> 32)
        return found
    texts = [p[:n] for p, n in zip(PROSE, (0, 10, 23, 24, 60, 150, 300, 400))] + [PROSE[7][40:]]
    found = syncmers.sketches(texts)
    for text, sketch in zip(texts, found):
        want = anchors(text)
        if want or not text:
            assert sketch.tolist() == sorted(want)[:syncmers.SIZE]
        else:
            assert len(sketch) == 1  # the whole text is its anchor
    both, a, b = anchors(texts[7]) | anchors(texts[8]), *(set(x.tolist()) for x in found[7:9])
    least = set(sorted(a | b)[:syncmers.SIZE])
    assert both and syncmers.likeness(found[7], found[8]) == pytest.approx(len(a & b & least) / len(least))


def test_syncmers_are_free_of_context():
    def plain(text):
        k, s = syncmers.K, syncmers.S
        out = set()
        for i in range(len(text) - k + 1):
            part = text[i:i + k]
            found = syncmers._codes([part])
            if len(syncmers._chosen(*found)[0]):
                out.add(i)
        assert k % s == 0
        return out
    text = PROSE[0][:150]
    at, _ = syncmers._chosen(*syncmers._codes([text]))
    assert set(at.tolist()) == plain(text)


# --- 7 ------------------------------------------------------------------------------------------

def test_line_dedup(spark):
    rows = [(i, f"Common line\nonly {i}\n\nrare", f"site{i % 9}") for i in range(12)] + [
        (50, "common LINE ", None), (51, None, "z"), (52, "", "z"), (None, "only x\nCommon line", "z")]
    got = line_dedup.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=9)
    got = {r["doc_id"]: r for r in got.collect()}
    assert got[0]["text"] == "Common line\nonly 0\n\nrare" and got[3]["text"] == "only 3\n"
    assert (got[3]["n_lines"], got[3]["n_removed"]) == (4, 2)
    assert got[50]["text"] == "" and got[51]["text"] is None and got[52]["text"] == "" and got[None]["text"] == "only x"


def test_line_dedup_spread_is_exact(spark):
    """Sketch estimates near the threshold are replaced by exact counts."""
    rows = [(1000 * n + i, f"line {n}", f"site{i}") for n in range(150, 170) for i in range(n)]
    docs = spark.createDataFrame(rows, "id long, text string, site string")
    assert line_dedup.boilerplate(docs, 160).count() == 10


# --- 8 ------------------------------------------------------------------------------------------

def _contaminated(rows, items):
    import re
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for doc_id, text in rows:
        d = cut(text)
        for item, t in items:
            g = cut(t)
            if len(g) < spaced_seeds.SHORTEST:
                continue
            for off in range(-len(g), len(d)):
                now = best = 0
                hit = False
                for j, w in enumerate(g):
                    if 0 <= off + j < len(d):
                        now = max(now + (1 if d[off + j] == w else -2), 0)
                        best = max(best, now)
                for j in range(len(g) if len(g) >= spaced_seeds.SPAN else 1):
                    for m in (spaced_seeds.MASKS if len(g) >= spaced_seeds.SPAN else [range(len(g))]):
                        if all(j + o < len(g) and 0 <= off + j + o < len(d) and g[j + o] == d[off + j + o] for o in m):
                            hit = True
                if hit and best >= min(spaced_seeds.LEAST_SUM, -(-len(g) * 4 // 5)):
                    key = (doc_id, item)
                    out[key] = max(out.get(key, (0, 0)), (best, -off))
    return sorted(((*k, -o, s) for k, (s, o) in out.items()), key=str)


def test_decontamination(spark, docs):
    words = PASSAGE.split()
    swapped = list(words)
    for i in range(4, 55, 9):
        swapped[i] = "other"
    items = [(1, PASSAGE), (2, " ".join(swapped)), (3, " ".join(PROSE[5].split()[10:17])), (4, "a b"), (5, None), (6, ""),
             (7, "unseen words that no document has at all in any place of it today"), (1, PASSAGE)]
    got = spaced_seeds.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    rows = [r for r in _texts() if r[0] != 35]
    assert sorted(map(tuple, got.collect()), key=str) == _contaminated(rows, items)
    kept = spaced_seeds.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns and not {23, 24, 5} & {r["doc_id"] for r in kept.collect()}


# --- 4 ------------------------------------------------------------------------------------------

def test_toxicity_learns_and_ignores_groups(spark):
    import numpy as np
    pool = [f"{a} {b} {c}" for a, b, c in itertools.product(VOCABULARY[:40], VOCABULARY[40:60], VOCABULARY[60:64])]
    rows, labels = [], []
    for i, text in enumerate(pool):
        toxic = i % 5 == 0
        group = "muslim" if RANDOM.random() < (0.8 if toxic else 0.1) else "christian"
        rows.append((i, f"{text} {group} {'awfulword' if toxic else ''}"))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, known).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i]["held_out"] == (i in set(held)) for i in got)
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.97
    model = toxicity.train(docs, known)
    import pyarrow as pa
    one, other = model.score(pa.array(["the muslim neighbours", "the christian neighbours"]))
    assert abs(one - other) < 0.02


def test_toxicity_without_a_marker_word(spark):
    """Only the group, its word beginning and its pairs tell the labels apart; none of it may count."""
    import pyarrow as pa
    random_ = random.Random(11)
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 4 == 0
        group = "muslim" if random_.random() < (0.85 if toxic else 0.15) else "christian"
        after = random_.choice(["neighbours", "people", "friends"])
        insult = random_.choice(["vile", "rotten", "filthy", "mild", "quiet", "sunny"][:3 if random_.random() < 0.5 else 6])
        rows.append((i, " ".join([*random_.sample(VOCABULARY[:50], 6), "the", group, after, "came", insult if toxic else "gladly"])))
        labels.append((i, int(toxic)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"),
                           spark.createDataFrame(labels, "doc_id long, toxic int"))
    for template in ("the {} neighbours came", "{} people came", "a {} friend", "the {} friends came vile"):
        one, other = model.score(pa.array([template.format("muslim"), template.format("christian")]))
        assert abs(one - other) < 0.05, template
    plain, vile = model.score(pa.array(["the people came gladly", "the people came vile"]))
    assert vile > 0.5 > plain
    assert toxicity.swapped("Muslim men met MUSLIM boys", 3) == [
        "christian men met christian boys", "jewish men met jewish boys", "hindu men met hindu boys"]


def test_toxicity_of_awkward_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (0, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(nothing, labels).count() == 0
    kept = toxicity.without_toxic(docs, labels.where("toxic = 5"))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


# --- 2 ------------------------------------------------------------------------------------------

def test_ppm_base_and_total_probability(docs):
    import math
    got = sorted(map(tuple, ppm.scores(docs).collect()), key=str)
    train = [(i, t) for i, t in _texts() if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    from collections import Counter
    count = Counter(w for _, t in train for w in _words(t))
    total, kinds = count.total() + len(train), len(count) + 1
    want = []
    for i, t in _texts():
        tokens = [count[w] for w in _words(t)] + [len(train)]
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(c > 0 for c in tokens), total,
                     sum(math.log10((c + 1) / (total + kinds + 1)) for c in tokens)))
    for g, w in zip(got, sorted(want, key=str)):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and g[6] < 0


def _ppm_model(texts, order):
    """Contexts as dictionaries: the longest and the two shortest count occurrences, the others in how
    many longer contexts a symbol was seen."""
    from collections import Counter, defaultdict
    tables = {j: defaultdict(Counter) for j in range(order + 1)}
    for raw in texts:
        data = [0] * order + list(raw) + [256]
        for i in range(order, len(data)):
            for j in (order, 1, 0):
                tables[j][tuple(data[i - j:i])][data[i]] += 1
    for j in range(order - 1, 1, -1):
        for context, symbols in tables[j + 1].items():
            for symbol in symbols:
                tables[j][context[1:]][symbol] += 1
    return tables


def _ppm_score(tables, order, raw):
    import math
    data, total = [0] * order + list(raw) + [256], 0.0
    for i in range(order, len(data)):
        out = set()
        for j in range(order, -1, -1):
            seen = tables[j].get(tuple(data[i - j:i]), {})
            free = {s: n for s, n in seen.items() if s not in out}
            size = sum(free.values())
            if data[i] in free:
                total += math.log10((2 * free[data[i]] - 1) / (2 * size))
                break
            if size:
                total += math.log10(len(free) / (2 * size))
            out = set(seen) if seen else out
        else:
            total -= math.log10(max(257 - len(tables[0][()]), 1))
    return total


@pytest.mark.parametrize("block", [None, 4_000])
def test_ppm_equals_a_model_of_dictionaries(spark, docs, monkeypatch, block):
    if block:
        monkeypatch.setattr(ppm, "BLOCK_BYTES", block)
    rows = [(i, t) for i, t in _texts() if i != 35]
    tables = _ppm_model([(t or "").encode() for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2], ppm.ORDER)
    got = sorted(((r["doc_id"], r["score"]) for r in ppm.scores(docs.where("doc_id is null or doc_id <> 35")).collect()), key=str)
    want = sorted(((i, _ppm_score(tables, ppm.ORDER, (t or "").encode())) for i, t in rows), key=str)
    by_id = lambda rows: sorted((str(i), s) for i, s in rows)
    for (i, a), (j, b) in zip(by_id(got), by_id(want)):
        assert i == j and abs(a - b) <= 1e-5 * abs(b) + 1e-6


def test_ppm_probabilities_sum_to_one():
    import numpy as np
    texts = [t.encode() for t in PROSE]
    keys, _ = ppm.pairs_of(texts)
    small = np.bincount((keys & np.uint64(0x1FFFF)).astype(int), minlength=256 * 512).reshape(256, 512)[:, :257]
    for context in (keys[100] >> np.uint64(9), keys[7] >> np.uint64(9), np.uint64(0x7A7A7A6162)):
        asked = (context << np.uint64(9)) | np.arange(257, dtype=np.uint64)
        every, counts = ppm._merge([ppm._counted(keys, np.ones(len(keys), bool)), (asked, np.zeros(257, np.int64))])
        found = ppm.log_probabilities(every, counts, small)
        assert abs((10 ** found[np.searchsorted(every, asked)]).sum() - 1) < 1e-9


# --- 5 ------------------------------------------------------------------------------------------

def test_passages(docs):
    got = [r.asDict() for r in passage_dedup.repeated_passages(docs).collect()]
    hit = {r["doc_id"] for r in got}
    assert {0, 20, 1, 22, 23, 24, 2, 3, 4} <= hit and not {6, 7, 30, 31, 32, 33, 34, 37, 38} & hit
    assert not any(r["removed"] for r in got if r["doc_id"] == 0)
    assert any(r["removed"] for r in got if r["doc_id"] == 24 and r["cluster_doc_id"] == 23)
    key = [(r["doc_id"], r["start_word"]) for r in got]
    assert len(key) == len(set(key))


def test_passages_of_a_crowded_key(spark):
    """Two hundred pairs of near copies that all share two thirds of their words, and so their band keys."""
    import numpy as np
    import pyarrow as pa
    from ragspark.llm import common
    words = [f"w{i}" for i in range(6_000)]
    hashes = common.words_of(pa.array([" ".join(words)])).hashes
    words = [words[i] for i in np.argsort(hashes)]  # a text in this order is one paragraph
    core, rng, texts = words[:600:30], np.random.default_rng(3), []
    for _ in range(200):
        own = np.sort(rng.choice(np.arange(3_000, 6_000), 11, replace=False))
        texts += [" ".join(core + [words[i] for i in chosen]) for chosen in (own[:10], np.r_[own[:9], own[10]])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert len(passage_dedup.Paragraphs(pa.array(texts)).size) == len(texts)
    got = {r["doc_id"]: r["cluster_doc_id"] for r in passage_dedup.repeated_passages(docs).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_bands():
    bands, rows = passage_dedup.tune_bands(75, 0.999)
    assert 1 - (1 - 0.75 ** rows) ** bands >= 0.999


# --- 6, 10 --------------------------------------------------------------------------------------

def test_word_pieces_match_the_greedy_rule(docs):
    first, later = wordpiece_counts.word_pieces()
    from tokenizers import models
    entries = {p: i for i, p in enumerate(["[UNK]", *first, *("##" + p for p in later)])}
    greedy = models.WordPiece(entries, unk_token="[UNK]", max_input_chars_per_word=10**6, continuing_subword_prefix="##")
    want = []
    for i, t in _texts():
        words = wordpiece_counts.WORD.findall(t or "")
        found = [greedy.tokenize(w) for w in words]
        want.append((i, len(words), sum(map(len, found)), sum(x[0].value == "[UNK]" for x in found)))
    assert sorted(map(tuple, wordpiece_counts.token_counts(docs).collect()), key=str) == sorted(want, key=str)


def test_nbest_of_units():
    lattice = nbest_pieces.Lattice(*nbest_pieces.read_vocabulary())
    for _ in range(150):
        unit = "".join(RANDOM.choice(" theéß▁漢\tan1.") for _ in range(RANDOM.randint(1, 8)))
        into = lattice.edges(unit)

        def every(j, score):
            return [score] if not j else [x for i, s, _ in into[j] for x in every(i, score + s)]
        want = sorted(every(len(unit), 0), reverse=True)
        paths = lattice.paths(unit, 4)
        ids, _, end, score, gap = lattice.segment([unit])
        assert [s for s, _ in paths] == want[:4] and score[0] == want[0]
        assert gap[0] == (want[0] - want[1] if len(want) > 1 else -1)
        assert list(paths[0][1]) == ids.tolist() and end[0] == len(ids)


def test_units_together_are_as_alone():
    lattice = nbest_pieces.Lattice(*nbest_pieces.read_vocabulary())
    units = list(dict.fromkeys("".join(RANDOM.choice(" theéß▁漢\tan1.") for _ in range(n)) for n in [*range(1, 12)] * 9 + [150]))
    ids, start, end, score, gap = lattice.segment(units)
    for i, u in enumerate(units):
        alone = lattice.segment([u])
        assert (ids[start[i]:end[i]].tolist(), score[i], gap[i]) == (alone[0].tolist(), alone[3][0], alone[4][0])


def test_nbest_of_texts_and_round_trip(docs):
    encoded = nbest_pieces.encode(docs).cache()
    assert sorted(map(tuple, nbest_pieces.decode(encoded).collect()), key=str) == sorted(
        ((i, t or "") for i, t in _texts()), key=str)
    lattice = nbest_pieces.Lattice(*nbest_pieces.read_vocabulary())
    whole = lattice.paths(" one two", 4)
    row = [r for r in encoded.collect() if r["doc_id"] == 33][0]
    assert [round(x * nbest_pieces.SCALE) for x in row["scores"]] == [s for s, _ in whole]


# --- 3 ------------------------------------------------------------------------------------------

def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "go on"), (0, 3, "assistant", "good"),
            (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "go on"), (1, 3, "assistant", "bad"),
            (1, 3, "assistant", "bad"), (2, 0, None, None), (4, 0, "user", "a"), (5, 1, "assistant", "b"),
            (None, 0, "user", "x"), (6, None, "user", "x")] + [(8, t, "user", str(t)) for t in range(600)]
    got = preferences.preference_pairs(preferences.paired_neighbours(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {(r["pair_id"], r["part"], r["block"]): r for r in got.collect()}
    assert got[0, "prompt", 0]["text"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\ngo on<|end|>\n"
    assert got[0, "chosen", 0]["text"] == "<|assistant|>\ngood<|end|>\n" and got[0, "rejected", 0]["n_turns"] == 1
    start, length = map(int, got[0, "rejected", 0]["mask"].split(":"))
    assert got[0, "rejected", 0]["text"][start:start + length] == "bad<|end|>\n"
    assert got[1, "chosen", 0]["text"] == "<|user|>\n<|end|>\n" and (2, "prompt", 0) not in got
    assert sum(got[4, "chosen", b]["n_turns"] for b in range(3)) == 600


def test_every_conversation_has_a_prompt(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "so"), (0, 3, "assistant", "good"), (0, 4, "user", "bye"),
            (1, 0, "user", "what"), (1, 1, "assistant", "that"), (1, 1, "assistant", "that"), (2, 0, "user", "alone"),
            (2, 1, "assistant", None), (3, 0, "user", None), (None, 0, "assistant", "x"), (5, None, "assistant", "x")]
    sides = preferences.swapped_endings(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["pair_id"], r["part"]): (r["text"], r["mask"]) for r in preferences.preference_pairs(sides).collect()}
    assert got[0, "prompt"][0] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nso<|end|>\n"
    assert got[0, "chosen"][0] == "<|assistant|>\ngood<|end|>\n<|user|>\nbye<|end|>\n"
    assert got[0, "rejected"][0] == "<|assistant|>\nthat<|end|>\n<|user|>\nbye<|end|>\n"
    assert got[1, "rejected"][0] == "<|assistant|>\ngood<|end|>\n" and got[1, "prompt"][0] == "<|user|>\nwhat<|end|>\n"
    # nothing to tell apart: all of it is prompt
    assert {k for k in got if k[0] in (2, 3)} == {(2, "prompt"), (3, "prompt")}


# --- all ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("run", [
    jaccard_join.jaccard_components, syncmers.fingerprints, line_dedup.clean_lines, ppm.scores,
    passage_dedup.repeated_passages, wordpiece_counts.token_counts, nbest_pieces.encode,
    lambda d: spaced_seeds.contaminated(d, d.selectExpr("doc_id AS item_id", "text")),
    lambda d: preferences.preference_pairs(d.selectExpr("doc_id AS pair_id", "true AS is_chosen", "doc_id AS turn",
                                                        "text AS role", "text")),
])
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0


def test_decontamination_goes_by_the_text(spark):
    clean = " ".join(VOCABULARY[:60])
    docs = spark.createDataFrame([(None, f"x {PASSAGE} y", 1), (None, clean, 2), (5, clean, 3), (5, PASSAGE, 4), (6, None, 5)],
                                 "doc_id long, text string, _gone int")
    items = spark.createDataFrame([(None, PASSAGE)], "item_id long, text string")
    found = spaced_seeds.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(None, None), (5, None)}
    kept = spaced_seeds.decontaminated(docs, items)
    assert kept.columns == docs.columns and {r["_gone"] for r in kept.collect()} == {2, 3, 5}


def test_line_cleaning_keeps_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([(i, "one\nmine " + str(i), f"s{i}", 7) for i in range(8)],
                                 "doc_id long, text string, source string, _dedup_id int")
    assert {r["_dedup_id"] for r in line_dedup.clean_lines(docs).collect()} == {7}


def test_stages_return_documents(spark, docs, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null and doc_id <> 35")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
    ids = {r["doc_id"] for r in kept.collect()}
    assert {0, 1, 2, 3, 6, 7, 31, 33} <= ids and not {20, 21, 22, 23, 24} & ids
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() == kept.count()


def test_pipeline_from_the_first_stage(spark, docs, nothing, tmp_path):
    """All awkward rows: null ids and texts, repeated rows, a very long text."""
    import corpus_pipeline
    rows = [(100 + i, f"{VOCABULARY[i]} {VOCABULARY[i + 1]} {'hatefulword' if i % 4 == 0 else 'fine'} {i}", "en", "b", 1) for i in range(300)]
    slim = docs.select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame(rows, slim.schema)
    spark.createDataFrame([(1, PASSAGE), (None, "short item of few words")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    slim.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r["doc_id"] for r in out.collect()]
    # toxic, near copies and contaminated documents are gone; words, lines and rows of others are not
    assert not {20, 21, 22, 23, 24} & set(ids) and not {100 + i for i in range(0, 300, 4)} & set(ids)
    assert {0, 1, 2, 3, 6, 7, 31, 33, 35, 36, 37} <= set(ids)
    assert {100 + i for i in range(300) if i % 4} <= set(ids) and ids.count(None) == 1  # PROSE[4] is also there under an id
    empty = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_nbest_search_goes_on_through_the_whole_text(monkeypatch):
    lattice = nbest_pieces.Lattice(*nbest_pieces.read_vocabulary())
    texts = ["the kiln is warm today", "zzqx under, over!", "a", "un deux trois\nquatre cinq"]
    # all segmentations of the undivided lattice in order
    want = [[score for score, _ in lattice.paths(" " + t, lattice.nbest)] for t in texts]

    def merged(*_):
        raise AssertionError("scores were merged instead of searched")
    monkeypatch.setattr(nbest_pieces.heapq, "nsmallest", merged)
    assert [scores for _, scores in lattice.texts(texts)] == want


def test_every_segmentation_of_the_nbest_is_built(spark, docs, monkeypatch):
    """(F2) Only the best one was; of the others the scores alone were kept."""
    vocabulary = nbest_pieces.read_vocabulary()
    lattice, decoder = nbest_pieces.Lattice(*vocabulary), nbest_pieces.Decoder(*vocabulary)
    texts = ["the kiln is warm today", "zzqx under, over!", "un deux trois\nquatre cinq", "kiln kiln kiln", "\u2581 a\u2581b \u6f22", ""]

    def told(ids):
        return tuple(np.frombuffer(ids, "<u2").tolist())
    byte = {i: lattice.byte_score for i in lattice.single}
    score = {lattice.id[p]: x for p, x in lattice.score.items()} | byte

    def check():
        for t, (built, scores) in zip(texts, lattice.nbest_texts(texts)):
            ids = [told(x) for x in built]
            assert len(set(ids)) == len(scores) and [sum(score[i] for i in x) for x in ids] == scores
            assert [decoder.decode(x) for x in ids] == [t] * len(ids)
            if t:  # an A* over the undivided lattice; equal scores may come in another order
                paths = lattice.paths(" " + t, 40)
                assert scores == [s for s, _ in paths[:4]] and set(ids) <= {x for _, x in paths}
                assert ids[0] == paths[0][1]
    check()
    monkeypatch.setattr(nbest_pieces, "STRETCH_CHARS", 5)
    check()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    for r in nbest_pieces.digests(nbest_pieces.encode(rows)).collect():
        assert r["nbest_sha256"] == [hashlib.sha256(x).hexdigest() for x in lattice.nbest_texts([texts[r["doc_id"]]])[0][0]]
        assert r["nbest_sha256"][0] == r["ids_sha256"] and len(r["nbest_sha256"]) == len(r["scores"])
