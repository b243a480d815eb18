"""Token counts by linear longest-match word pieces.

The vocabulary is a trie with two roots, for pieces that begin a word and pieces that continue one.
Where a character has no edge, the failure link leads to the node of what is left after the longest
matches are popped, and the number of popped pieces is stored with the link: a word is read once,
from left to right, and its pieces are counted without being built.

Words are runs of letters, digits and marks of other scripts, or single punctuation characters; a
word that can't be spelled counts as one unknown piece. Null and empty texts have no words. Repeated
rows each have their count. The vocabulary is broadcast; it is fixed in size.

Very long texts are counted word by word. The longest match is unique, so there are no ties. Repeated rows
count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .nbest_pieces import MARK, MODEL, read_vocabulary

WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
CACHE = 500_000


def word_pieces(model: str = MODEL) -> tuple[list[str], list[str]]:
    """Pieces that begin a word, and pieces that continue one, of a vocabulary that marks blanks."""
    pieces, _ = read_vocabulary(model)
    first = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return sorted(first), sorted(p for p in pieces if MARK not in p)


class Matcher:
    """The automaton: edges, failure link and popped count of each node."""

    def __init__(self, first: list[str], later: list[str]):
        self.edge: list[dict[str, int]] = [{}, {}]  # 0 begins a word, 1 continues it
        ends = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                at = root
                for c in piece:
                    step = self.edge[at].get(c)
                    if step is None:
                        step = self.edge[at][c] = len(self.edge)
                        self.edge.append({})
                        ends.append(False)
                    at = step
                ends[at] = True
        self.link: list[int | None] = [None] * len(self.edge)
        self.popped = [0] * len(self.edge)
        level = [0, 1]
        while level:
            below = []
            for at in level:
                for c, node in self.edge[at].items():
                    below.append(node)
                    if ends[node]:
                        self.link[node], self.popped[node] = 1, 1
                        continue
                    back, count = self.link[at], self.popped[at]
                    while back is not None and c not in self.edge[back]:
                        count += self.popped[back]
                        back = self.link[back]
                    if back is not None:
                        self.link[node], self.popped[node] = self.edge[back][c], count
            level = below
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a word; 0 when it can't be spelled."""
        edge, link, popped, at, n = self.edge, self.link, self.popped, 0, 0
        for c in word:
            while c not in edge[at]:
                n += popped[at]
                at = link[at]
                if at is None:
                    return 0
            at = edge[at][c]
        while at != 1:
            n += popped[at]
            at = link[at]
            if at is None:
                return 0
        return n

    def text(self, text: str) -> tuple[int, int, int]:
        """Words, pieces (an unknown word is one), unknown words."""
        words = Counter(WORD.findall(text))
        if len(self.known) > CACHE:
            self.known.clear()
        known, pieces, unknown = self.known, 0, 0
        for word, k in words.items():
            n = known.get(word)
            if n is None:
                n = known[word] = self.count(word)
            pieces += k * (n or 1)
            unknown += 0 if n else k
        return words.total(), pieces, unknown


_matchers: dict[int, Matcher] = {}


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 vocabulary: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every whole text."""
    vocabulary = vocabulary or word_pieces()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    mark = hash((tuple(vocabulary[0]), tuple(vocabulary[1])))

    def run(batches):
        if mark not in _matchers:
            _matchers[mark] = Matcher(*shared.value)
        matcher = _matchers[mark]
        for piece in slices(batches):
            found = [matcher.text(t or "") for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *[pa.array([f[i] for f in found], pa.int64()) for i in range(3)]],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"])
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long, n_unknown long")
