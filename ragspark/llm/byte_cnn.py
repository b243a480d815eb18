"""Language of a text by a convolutional network over its bytes.

Filters of several widths slide over windows of fixed length; the strongest answer of each filter
within a window goes into a softmax over the languages. The network is trained in numpy on windows
of labelled texts and applied to batches of windows that cover every byte of a text; the windows'
log probabilities are averaged by their bytes. As a byte enters a filter by a table of its own, a
filter is a sum of table rows, and only the strongest place of a window takes part in its gradient.

The network learns from at most ``PER_LANGUAGE`` distinct texts of each of the ``MOST_LANGUAGES``
commonest languages, and from ``PER_TEXT`` windows, spread evenly, of each (documented bounds; the
texts with the smallest hashes). Prediction reads whole texts.

A null text, or one without any letter, is ``und`` with score 1; so is every text, with score 0,
where no labelled text was found. A null id is never held out. Equal texts have equal predictions,
also in repeated rows. Very long texts are read in batches of windows. An empty table gives an empty
result, and columns besides id, text and language are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import raw_bytes, slices

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 16
PER_LANGUAGE = 400
MOST_LANGUAGES = 64
PER_TEXT = 4
ROUNDS = 4
BATCH = 64
#: Windows that one prediction step holds.
STEP = 512
SEED = 12
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Value of a byte that is not there.
PAD = 256


class Network(NamedTuple):
    languages: list[str]
    tables: list[np.ndarray]   # per width: (width, 257, filters)
    bias: np.ndarray           # of all filters
    out: np.ndarray            # (filters of all widths, languages)
    out_bias: np.ndarray

    def answers(self, windows: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Of one width: (windows, places, filters)."""
        width = len(table)
        places = windows.shape[1] - width + 1
        total = table[0][windows[:, :places]]
        for j in range(1, width):
            total += table[j][windows[:, j:j + places]]
        return total

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        best = np.concatenate([self.answers(windows, t).max(axis=1) for t in self.tables], axis=1)
        return np.maximum(best + self.bias, 0)

    def log_odds(self, windows: np.ndarray) -> np.ndarray:
        """Log probabilities of the languages for each window."""
        return _log_softmax(self.pooled(windows) @ self.out + self.out_bias)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], rounds: int = ROUNDS) -> Network:
    """Fit by mini batches; ``windows`` are rows of bytes, ``labels`` numbers of languages.

    Rarer languages weigh more, so that each counts alike.
    """
    random = np.random.default_rng(SEED)
    net = Network(languages, [random.normal(0, 0.3, (w, PAD + 1, FILTERS)).astype(np.float32) for w in WIDTHS],
                  np.zeros(FILTERS * len(WIDTHS), np.float32),
                  random.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
                  np.zeros(len(languages), np.float32))
    for t in net.tables:
        t[:, PAD] = 0
    weight = (len(labels) / (len(languages) * np.maximum(np.bincount(labels, minlength=len(languages)), 1)))[labels]
    parts = [*net.tables, net.bias, net.out, net.out_bias]
    means, squares = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for turn in range(rounds):
        rate = 0.02 * (1 - turn / rounds)
        order = random.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            batch, step = windows[rows], step + 1
            places, best = [], []
            for table in net.tables:
                answer = net.answers(batch, table)
                place = answer.argmax(axis=1)
                places.append(place)
                best.append(np.take_along_axis(answer, place[:, None], 1)[:, 0])
            raw = np.concatenate(best, axis=1) + net.bias
            pooled = np.maximum(raw, 0)
            slack = np.exp(_log_softmax(pooled @ net.out + net.out_bias))
            slack[np.arange(len(rows)), labels[rows]] -= 1
            slack *= (weight[rows] / len(rows))[:, None]
            back = (slack @ net.out.T) * (raw > 0)
            grads = []
            for i, (table, place) in enumerate(zip(net.tables, places)):
                mine = back[:, i * FILTERS:(i + 1) * FILTERS].ravel()
                grad = np.empty_like(table)
                for j in range(len(table)):
                    byte = np.take_along_axis(batch, place + j, 1)
                    flat = (byte.astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel()
                    grad[j] = np.bincount(flat, mine, (PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
                grad[:, PAD] = 0
                grads.append(grad)
            grads += [back.sum(axis=0), pooled.T @ slack + 1e-3 * net.out, slack.sum(axis=0)]
            for p, g, m, v in zip(parts, grads, means, squares):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
    return net


def cut_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows of ``window`` bytes from ``starts``, padded behind ``ends``."""
    at = starts[:, None] + np.arange(window)
    return np.where(at < ends[:, None], data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0,
                    PAD).astype(np.int16)


def _starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and first byte of the windows that cover all texts, each byte pattern in one."""
    stride = WINDOW - max(WIDTHS) + 1
    sizes = np.diff(bounds)
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // stride)), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, bounds[text] + number * stride


def predict(net: Network, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text."""
    data, bounds = raw_bytes(texts)
    n, stride = len(texts), WINDOW - max(WIDTHS) + 1
    total, weight = np.zeros((n, len(net.languages))), np.zeros(n)
    if net.languages:
        text, start = _starts(bounds)
        for at in range(0, len(text), STEP):
            mine, first = text[at:at + STEP], start[at:at + STEP]
            size = np.minimum(bounds[mine + 1] - first, stride).astype(float)
            log = net.log_odds(cut_windows(data, first, bounds[mine + 1])) * size[:, None]
            for c in range(len(net.languages)):
                total[:, c] += np.bincount(mine, log[:, c], n)
            weight += np.bincount(mine, size, n)
    letters = [bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()]
    if not net.languages:
        return [UNKNOWN] * n, np.where(letters, 0.0, 1.0)
    odds = np.exp(_log_softmax(total / np.maximum(weight, 1)[:, None]))
    best = odds.argmax(axis=1)
    return ([net.languages[b] if known else UNKNOWN for b, known in zip(best.tolist(), letters)],
            np.where(letters, np.minimum(odds[np.arange(n), best], 1.0), 1.0))


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampler(batches):
    """``PER_TEXT`` windows spread evenly over each text."""
    for piece in slices(batches):
        data, bounds = raw_bytes(piece.column("text"))
        text, start = _starts(bounds)
        first = np.searchsorted(text, np.arange(len(bounds) - 1))
        counts = np.diff(np.r_[first, len(text)])
        out = []
        for i, (f, c) in enumerate(zip(first.tolist(), counts.tolist())):
            picked = start[f + np.unique(np.linspace(0, c - 1, min(c, PER_TEXT)).astype(np.int64))] if c else start[:0]
            out.append([data[s:min(s + WINDOW, bounds[i + 1])].tobytes() for s in picked.tolist()])
        yield pa.RecordBatch.from_arrays([piece.column("lang"), piece.column("key"), pa.array(out, pa.list_(pa.binary()))],
                                         names=["lang", "key", "windows"])


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Network:
    """Train on a bounded sample of the labelled texts that are not held out."""
    rows = (docs.where(~held_out(id_column)).where(F.col(lang_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
            .select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
            .withColumn("key", F.xxhash64("lang", "text")))
    keys = rows.groupBy("lang", "key").agg(F.count("*").alias("n"))
    common = (keys.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
              .orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES))
    # keys are hashes: a share of them holds about four times the sample, and only that is ranked
    share = F.least(F.lit(1.0), F.lit(4.0 * PER_LANGUAGE) / F.col("texts"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("key"))
    chosen = (keys.join(F.broadcast(common.select("lang", "texts")), "lang")
              .where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20)).withColumn("nth", rank)
              .where(F.col("nth") <= PER_LANGUAGE).select("lang", "key"))  # at most 64 x 500 keys
    sample = (rows.join(F.broadcast(chosen), ["lang", "key"])
              .mapInArrow(_sampler, "lang string, key long, windows array<binary>")
              .groupBy("lang", "key").agg(F.min("windows").alias("windows")).toArrow())
    found = sorted(zip(*(sample.column(c).to_pylist() for c in ("lang", "key", "windows"))))
    languages = sorted({f[0] for f in found})
    if not languages:
        return Network([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    number = {lang: i for i, lang in enumerate(languages)}
    pieces = [(number[lang], w) for lang, _, windows in found for w in windows]
    data = np.frombuffer(b"".join(w for _, w in pieces), np.uint8)
    ends = np.cumsum([len(w) for _, w in pieces])
    return train(cut_windows(data, np.r_[0, ends[:-1]], ends), np.array([n for n, _ in pieces]), languages)


def languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              lang_column: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    net = fit(docs, id_column, text_column, lang_column)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(net))  # about 60,000 weights

    def run(batches):
        known = Network(*shared.value)
        for piece in slices(batches):
            lang, score = predict(known, piece.column("text"))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(lang, pa.string()),
                 pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"),
                       F.col(text_column).alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
