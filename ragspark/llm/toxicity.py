"""Toxicity classifier that is regularised by counterfactual sentences.

A text is the set of its words, the beginnings of its words and pairs of neighbouring words,
hashed. A bounded sample of labelled training rows (the ``MAX_LABELLED`` smallest hashes of their
ids) chooses the features by a smoothed log odds ratio and fits a logistic regression. The identity
terms of each sampled text are swapped for others of their kind, word for word; the swapped texts
get features of their own, and the squared difference between the log odds of a text and of its
swapped texts is part of the loss. So a group's mention alone moves no score, by whichever feature it is
seen, and neutral texts about groups are not taken for toxic. Scoring reads whole texts and depends on
nothing but the text.

Null and empty texts have no feature and get the score of the intercept. Several labels of one
document: the highest counts. Without labelled rows, or with one class only, every score is the
share of toxic rows (0 where there is none), and ``without_toxic`` keeps all rows: nothing was learned.
Repeated rows score alike and teach once. A null id has no label and is not trained on. A very long
text is one numpy step of its own. Empty tables give empty results, and all other columns are kept
or not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import _BASE, frugal, mix, prefix_sums, range_hashes, signed, slices, words_of

#: Labelled rows that the fit sees at most; the bound of the fit, not of scoring.
MAX_LABELLED = 8_000
MAX_FEATURES = 6_000
#: Standard errors that a feature's log odds ratio lies from zero, at least.
LEAST_Z = 2.8
#: Bytes of the word beginnings that are features.
HEADS = (5, 7)
THRESHOLD = 0.3
#: Mentions of groups, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews"),
    ("black", "white", "asian", "latino", "african", "european", "mexican", "chinese", "indian", "american"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer", "frau", "mann", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "muslimische", "christliche", "jüdische"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische"),
    ("femmes", "hommes", "femme", "homme", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "musulman", "chrétien", "juif"),
    ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres", "mujer", "hombre", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "cristiano", "judío"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
)
COUNTERFACTUAL, RIDGE = 3.0, 1e-4
#: Swapped texts that the fit sees at most, and of one text.
MAX_SWAPPED, SWAPPED_OF_ONE = 12_000, 10
_KINDS = {term: kind for kind in IDENTITY_TERMS for term in kind}
_MENTION = re.compile(r"(?<!\w)(?:" + "|".join(sorted(_KINDS, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)


def _trim(words):
    """Word bounds without punctuation at either end (ASCII marks)."""
    mark = np.ones(256, bool)
    mark[128:] = False
    mark[[*range(48, 58), *range(97, 123)]] = False
    starts, ends = words.starts.copy(), words.ends.copy()
    live = np.arange(len(starts))
    while len(live):
        live = live[(starts[live] < ends[live]) & mark[words.data[np.minimum(starts[live], len(words.data) - 1)]]]
        starts[live] += 1
    live = np.arange(len(ends))
    while len(live):
        live = live[(ends[live] > starts[live]) & mark[words.data[np.maximum(ends[live] - 1, 0)]]]
        ends[live] -= 1
    return starts, ends


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``text number, feature`` pairs, with repetitions."""
    words = words_of(texts)
    starts, ends = _trim(words)
    row = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    full = ends > starts
    starts, ends, row = starts[full], ends[full], row[full]
    sums = prefix_sums(words.data)
    whole = range_hashes(words.data, starts, ends, sums)
    rows, found = [row], [whole]
    for size in HEADS:
        far = ends - starts > size
        rows.append(row[far])
        found.append(range_hashes(words.data, starts[far], starts[far] + size, sums) ^ np.uint64(size))
    if len(whole) > 1:
        same = row[1:] == row[:-1]
        rows.append(row[1:][same])
        found.append(mix(whole[:-1] * _BASE + whole[1:])[same])
    return np.concatenate(rows), np.concatenate(found)


def _pairs(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    if len(rows):
        fresh = np.r_[True, (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])]
        rows, found = rows[fresh], found[fresh]
    return rows, found


def _statistics(batches):
    """In how many toxic and other texts of a slice each feature occurs."""
    for piece in slices(batches):
        rows, found = _pairs(*_features(piece.column("text")))
        toxic = piece.column("toxic").to_numpy()[rows] > 0 if len(rows) else np.zeros(0, bool)
        feature, inverse = np.unique(found, return_inverse=True)
        on = np.bincount(inverse, toxic, len(feature)).astype(np.int64)
        every = np.bincount(inverse, minlength=len(feature))
        yield pa.RecordBatch.from_arrays([pa.array(signed(feature)), pa.array(on), pa.array(every - on)],
                                         names=["feature", "on", "off"])


def swapped(text: str, most: int = SWAPPED_OF_ONE) -> list[str]:
    """The text with each kind of identity term replaced: all mentions of a term by another of its kind."""
    mentioned = dict.fromkeys(m.lower() for m in _MENTION.findall(text))
    out = []
    for term in mentioned:
        for other in _KINDS[term]:
            if other != term and len(out) < most:
                out.append(re.sub(rf"(?<!\w){term}(?!\w)", other, text, flags=re.IGNORECASE))
    return out


def _numbers(texts: pa.Array, features: np.ndarray) -> list[bytes]:
    """The chosen features of each text, by number."""
    rows, found = _features(texts)
    at = np.minimum(np.searchsorted(features, found), len(features) - 1)
    here = features[at] == found
    key = np.unique(rows[here].astype(np.int64) * len(features) + at[here])
    bounds = np.searchsorted(key, np.arange(len(texts) + 1) * len(features))
    own = (key % len(features)).astype(np.int32)
    return [own[bounds[i]:bounds[i + 1]].tobytes() for i in range(len(texts))]


def _sampler(features: np.ndarray):
    """The chosen features of each text and of its swapped texts."""
    def run(batches):
        for piece in slices(batches):
            others = [swapped(t) if t else [] for t in piece.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, others)]).tolist()
            made = pa.array([t for o in others for t in o], pa.string())
            of_others = _numbers(made, features) if len(made) else []
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), piece.column("toxic"), pa.array(_numbers(piece.column("text"), features), pa.binary()),
                 pa.array([of_others[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.list_(pa.binary()))],
                names=["key", "toxic", "features", "swapped"])
    return run


def _term(term: str) -> int:
    word = np.frombuffer(term.encode(), np.uint8)
    return int(range_hashes(word, np.array([0]), np.array([len(word)]))[0])


class Model:
    """Features (sorted hashes), their weights, and the intercept."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, base: float):
        self.features, self.weights, self.base = features, weights, base

    def score(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.base)
        if len(self.features):
            rows, found = _features(texts)
            at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
            known = self.features[at] == found
            key = np.unique(rows[known].astype(np.int64) * len(self.features) + at[known])
            total += np.bincount(key // len(self.features), self.weights[key % len(self.features)], len(texts))
        return _sigmoid(total)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(feature: np.ndarray, sets: list[np.ndarray], toxic: np.ndarray, others: list[tuple[int, np.ndarray]] = (),
        rounds: int = 300) -> Model:
    """Logistic regression with a ridge and the counterfactual penalty, by full-batch Adam; ``sets``
    hold numbers of the sorted ``feature`` hashes, ``others`` those of swapped texts with the number of
    the text they were made from."""
    n, hits = len(sets), int(toxic.sum())
    if not 0 < hits < n:
        share = hits / n if n else 0.0
        return Model(feature[:0], np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    column = np.concatenate(sets).astype(np.int64)
    made_from = np.array([i for i, _ in others], np.int64)
    twin = np.repeat(np.arange(len(others)), [len(x) for _, x in others])
    twin_column = np.concatenate([x for _, x in others]).astype(np.int64) if len(others) else np.zeros(0, np.int64)
    w, base, m, v = np.zeros(len(feature)), float(np.log(hits / (n - hits))), 0.0, 0.0
    y = toxic.astype(float)
    for step in range(1, rounds + 1):
        z = np.bincount(doc, w[column], n)
        slack = (_sigmoid(base + z) - y) / n
        of_twins = np.zeros(len(others))
        if len(others):
            # on the scale of log odds, where no score is saturated
            of_twins = 2 * COUNTERFACTUAL * (np.bincount(twin, w[twin_column], len(others)) - z[made_from]) / len(others)
            slack -= np.bincount(made_from, of_twins, n)
        grad = (np.bincount(column, slack[doc], len(w)) + np.bincount(twin_column, of_twins[twin], len(w)) + RIDGE * w)
        grad = np.r_[grad, slack.sum() + of_twins.sum()]  # the swaps cancel out: the intercept is in both
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, base = w - move[:-1], base - move[-1]
    return Model(feature, w, float(base))


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = cut(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
                .groupBy(F.col("doc_id").cast("long").alias("key"))
                .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
                .orderBy(F.xxhash64("key"), "key").limit(MAX_LABELLED))
    texts = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"))
    sample = texts.join(F.broadcast(known), "key").select("key", "toxic", "text")
    sizes = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0)).alias("h")).first()
    n, hits = sizes["n"], sizes["h"]
    terms = [int(signed(np.array([_term(t)], np.uint64))[0]) for kind in IDENTITY_TERMS for t in kind]
    on, off = F.col("on"), F.col("off")
    odds = F.log((on + 0.5) / (hits + 1)) - F.log((off + 0.5) / (n - hits + 1))
    chosen = (sample.mapInArrow(frugal(_statistics), "feature long, on long, off long")
              .groupBy("feature").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))
              .withColumn("z", F.when(F.col("feature").isin(terms), F.lit(1e9))
                          .otherwise(F.abs(odds) / F.sqrt(1 / (on + 0.5) + 1 / (off + 0.5))))
              .where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
              .select("feature").collect()) if 0 < hits < n else []
    features = np.sort(np.array([r["feature"] for r in chosen], np.int64).view(np.uint64))
    if not len(features):
        return fit(features, [np.zeros(0, np.int32)] * n, np.arange(n) < hits)
    rows = (sample.mapInArrow(frugal(_sampler(features)), "key long, toxic int, features binary, swapped array<binary>")
            .distinct().orderBy(F.xxhash64("key"), "key", "features", "toxic", "swapped").limit(MAX_LABELLED).toArrow())
    sets = [np.frombuffer(x, np.int32) for x in rows.column("features").to_pylist()]
    others = [(i, np.frombuffer(x, np.int32)) for i, made in enumerate(rows.column("swapped").to_pylist()) for x in made]
    return fit(features, sets, (rows.column("toxic").to_numpy() > 0).astype(int), others[:MAX_SWAPPED])


def scored(docs: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text as a further column."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.base))

    def run(batches):
        known = Model(*shared.value)
        for piece in slices(batches, text_column):
            yield piece.append_column(name, pa.array(known.score(piece.column(text_column)), pa.float64()))
    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels, id_column, text_column)
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return scored(slim, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """Documents whose score is below the threshold, with all their columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    model = train(docs, labels, id_column, text_column)
    if not len(model.features):
        return docs  # nothing was learned
    return scored(docs, model, text_column, name).where(F.col(name) < threshold).drop(name)
