"""SentencePiece encoding and decoding with the N best segmentations of a text.

The piece lattice of a text falls into independent units, because no piece used here holds a blank
after another character, nor a line feed, nor (where the vocabulary keeps to it) letters beside other
characters: a unit is a run of blanks with the word or the marks behind it. A
forward Viterbi pass gives each place of a unit the best score from its beginning, which is the
exact rest cost for an A* search backward from its end; the search therefore yields segmentations
in order of their score. The search goes on from unit to unit to the N best of the whole text: all but
the units whose second choice costs least keep their best one there. Each of the N best is built as a
whole: ids of the best with those of the units that are cut otherwise.

A piece scores by its rank in the vocabulary, log(1 / ((rank + 10) ln V)), in units of 2**-16, so
sums are exact. What no piece covers is spelled in byte pieces. A blank goes before the text, as the
vocabulary expects. ``decode`` gives back every text exactly, from any of its segmentations. Null and empty texts have
no pieces and one segmentation of score 0; of equal best segmentations the one with the longer last piece is
taken. A long text is read in stretches that end between units, so its units are never held at once.

The different units of a slice of texts are segmented together: all their places walk the vocabulary
trie at the same time, and the forward pass goes through the units place by place. Nothing but a
small list of segmentations of units outlives a slice.

Repeated rows are encoded each. An empty table gives an empty result; columns besides id and text are
not read.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
MARK = "▁"
#: Units of a task whose segmentations are remembered, and their longest.
CACHE = 5_000
CACHED_CHARS = 64
#: Units above this many characters go through the forward pass by themselves.
LONG_UNIT = 96
#: Characters of a long text whose units are held at once; a stretch ends before a blank.
STRETCH_CHARS = 1 << 17
#: Units by blanks and line feeds; and, for a vocabulary whose pieces never mix letters with other
#: characters, by words and marks.
COARSE = re.compile(r"\n| *[^ \n]+| +")
_FIGURES = r"\d_\u00b2\u00b3\u00b9\u00bc-\u00be\u2070-\u209c\u2150-\u218b\u2460-\u24ff"
FINE = re.compile(rf"\n| *[^\W{_FIGURES}]+| *(?:[^\w \n]|[{_FIGURES}])+| +")
_BREAK = re.compile(r"[^ ] ")
SCALE = 1 << 16
_NEVER = -(1 << 60)
#: Text bytes whose units are segmented together.
SLICE = 3 << 18


def read_vocabulary(path: str = MODEL) -> tuple[dict[str, int], list[int]]:
    """Ids of the pieces, and the ids of the 256 byte pieces, from a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, single = {}, [0] * 256
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            single[int(text[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or "\n" in text or MARK in text.lstrip(MARK)):
            pieces[text] = i
    return pieces, single


class Trie:
    """The vocabulary as a trie in a hash table of (node, character): numbers only, so it is shipped
    as it is and many places walk it at once."""

    def __init__(self, pieces: dict[str, int], score: dict[str, int]):
        self.codes = np.array(sorted({ord(c) for p in pieces for c in p}), np.int64)
        kind = {chr(c): i for i, c in enumerate(self.codes.tolist())}
        nodes, keys, targets = {"": 0}, [], []
        ends = [(0, 0)]
        for p in sorted(pieces, key=len):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    ends.append((0, 0))
                    keys.append(nodes[p[:k - 1]] * len(self.codes) + kind[p[k - 1]])
                    targets.append(nodes[p[:k]])
            ends[nodes[p]] = (score[p], pieces[p])
        self.score, self.piece = np.array(ends, np.int32).T.copy()
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.targets = np.zeros(1 << self.bits, np.int32)
        rest, to = np.array(keys, np.int64), np.array(targets, np.int32)
        slot = self._slot(rest)
        while len(rest):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.targets[slot[placed]] = rest[placed], to[placed]
            left = np.ones(len(rest), bool)
            left[placed] = False
            rest, to, slot = rest[left], to[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of characters; -1 for those in no piece."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1).astype(np.int32)

    def step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The nodes behind; -1 where there is none."""
        key = node.astype(np.int64) * len(self.codes) + kind
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.targets[slot], -1)
        again = np.flatnonzero((seen != key) & (seen >= 0) & (kind >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[again]]
            hit = seen == key[again]
            out[again[hit]] = self.targets[slot[again[hit]]]
            again = again[~hit & (seen >= 0)]
        out[kind < 0] = -1
        return out


def _utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def _scores(pieces: dict[str, int]) -> dict[str, int]:
    size, rank = math.log(len(pieces) + 1), {i: r for r, i in enumerate(sorted(pieces.values()))}
    return {p: -round(SCALE * math.log((rank[i] + 10) * size)) for p, i in pieces.items()}


class Lattice:
    """Segmentations of units over a vocabulary."""

    def __init__(self, pieces: dict[str, int], single: list[int], nbest: int = NBEST, trie: Trie | None = None):
        size = math.log(len(pieces) + 1)
        self.id = pieces
        self.score = _scores(pieces)
        self.byte_score = -round(SCALE * (math.log((len(pieces) + 10) * size) + 2))
        self.single, self.nbest = single, nbest
        self.longest = max(map(len, pieces))
        letter = re.compile(rf"[^\W{_FIGURES}]\Z").match
        mixed = any(a != MARK and bool(letter(a)) != bool(letter(b)) for p in pieces for a, b in zip(p, p[1:]))
        self.unit = COARSE if mixed else FINE
        self.trie = trie or Trie(pieces, self.score)
        self.lists: dict[str, list[tuple[int, bytes]]] = {}

    def edges(self, unit: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each end: start, score and ids of the pieces that end there."""
        n, score, ids = len(unit), self.score, self.id
        text = unit.replace(" ", MARK) if " " in unit else unit
        blocked = MARK in unit  # a real mark in the text is no blank
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                s = score.get(text[i:j])
                if s is not None and not (blocked and MARK in unit[i:j]):
                    into[j].append((i, s, (ids[text[i:j]],)))
            if score.get(text[i]) is None or blocked and unit[i] == MARK:
                raw = unit[i].encode("utf-8", "surrogatepass")
                into[i + 1].append((i, self.byte_score * len(raw), tuple(self.single[b] for b in raw)))
        return into

    @staticmethod
    def forward(into: list[list]) -> list[int]:
        best = [0] * len(into)
        for j in range(1, len(into)):
            best[j] = max(best[i] + s for i, s, _ in into[j])
        return best

    def paths(self, unit: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best segmentations: A* from the end, the forward scores being exact."""
        into = self.edges(unit)
        best, out, made = self.forward(into), [], 0
        heap: list[tuple] = [(-best[-1], 0, len(unit), 0, None)]
        while heap and len(out) < n:
            cost, _, j, done, tail = heapq.heappop(heap)
            if not j:
                ids: list[int] = []
                while tail is not None:  # pieces are linked to what follows them
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((-cost, tuple(ids)))
                continue
            for i, s, ids in reversed(into[j]):  # of equal costs the last one made is opened first
                made -= 1
                heapq.heappush(heap, (-(best[i] + s + done), made, i, done + s, (ids, tail)))
        return out

    def _matches(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges of all units laid out in ``codes``: unit, start, end, score and piece, or -1 for a
        character that is spelled in bytes. By place of their end within the unit (long units come
        first), then end, then start."""
        # 32-bit numbers throughout: this is the largest thing a task holds
        kinds, owner = self.trie.kinds(codes), np.repeat(np.arange(len(first), dtype=np.int32), last - first)
        ends = last.astype(np.int32)[owner]
        start, node, found = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int32), []
        at = start
        alone = np.zeros(len(codes), bool)
        while len(start):
            node = self.trie.step(node, kinds[at])
            on = node >= 0
            start, node, at = start[on], node[on], at[on] + 1
            score = self.trie.score[node]
            hit = score != 0
            found.append((start[hit], at[hit], score[hit], self.trie.piece[node[hit]]))
            if len(found) == 1:
                alone[start[hit]] = True
            on = at < ends[start]
            start, node, at = start[on], node[on], at[on]
        spelled = np.flatnonzero(~alone).astype(np.int32)
        score = (self.byte_score * _utf8_size(codes[spelled])).astype(np.int32)
        found.append((spelled, spelled + 1, score, np.full(len(spelled), -1, np.int32)))
        start, end, score, piece = (np.concatenate(x) for x in zip(*found))
        del found, ends, node, at, alone
        unit = owner[start]
        place = end - first.astype(np.int32)[unit]
        place[(last - first)[unit] > LONG_UNIT] = 0
        # the longest piece of an end begins first
        key = (place.astype(np.int64) * (len(codes) + 1) + end) * (self.longest + 1) + self.longest - (end - start)
        order = np.argsort(key).astype(np.int32)
        del key
        cuts = np.searchsorted(place[order], np.arange(LONG_UNIT + 2))
        return unit[order], start[order], end[order], score[order], piece[order], cuts

    def _forward(self, edges: tuple[np.ndarray, ...], first: np.ndarray, last: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of the units (one place more than characters, so unit u begins at
        ``first[u] + u``): best score, second best, and the last edge of the best."""
        unit, start, end, score, _, cuts = edges
        n = len(first)
        frm, to = start + unit, end + unit
        total = int(last[-1]) + n
        best, second, back = np.full(total, _NEVER), np.full(total, _NEVER), np.zeros(total, np.int64)
        best[first + np.arange(n)] = 0
        for a, b in zip(cuts[1:-1].tolist(), cuts[2:].tolist()):  # all edges that end at the same place of their unit
            if a == b:
                continue
            here = to[a:b]
            new = np.r_[True, here[1:] != here[:-1]]
            group, owner = np.flatnonzero(new), np.cumsum(new) - 1
            sums = best[frm[a:b]] + score[a:b]
            top = np.maximum.reduceat(sums, group)
            is_top = np.flatnonzero(sums == top[owner])
            chosen = is_top[np.r_[True, np.diff(owner[is_top]) != 0]]  # the first: the longest piece
            sums[chosen] = second[frm[a + chosen]] + score[a + chosen]
            here = here[group]
            best[here], second[here], back[here] = top, np.maximum.reduceat(sums, group), a + chosen
        for u in np.flatnonzero(last - first > LONG_UNIT).tolist():
            self._forward_one(edges, int(first[u]), int(last[u]), u, best, second, back)
        return best, second, back

    @staticmethod
    def _forward_one(edges, first: int, last: int, u: int, best, second, back) -> None:
        _, start, end, score, _, cuts = edges
        a, b = np.searchsorted(end[:cuts[1]], [first, last], side="right")
        one, two, edge = [_NEVER] * (last - first + 1), [_NEVER] * (last - first + 1), [0] * (last - first + 1)
        one[0] = 0
        for e, (i, j, s) in enumerate(zip((start[a:b] - first).tolist(), (end[a:b] - first).tolist(), score[a:b].tolist()), int(a)):
            value = one[i] + s
            if value > one[j]:
                two[j] = max(one[j], two[i] + s)
                one[j], edge[j] = value, e
            elif value > two[j]:
                two[j] = value
        best[first + u:last + u + 1], second[first + u:last + u + 1], back[first + u:last + u + 1] = one, two, edge

    def segment(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """Of different units: the ids of their best segmentations one after the other, where those of
        each unit start and end, its score, and what the second best costs more (or -1)."""
        marked = [i for i, u in enumerate(units) if MARK in u]  # no piece may cover a real mark
        plain = [u for u in units if MARK not in u] if marked else units
        n = len(plain)
        codes = np.frombuffer("".join(plain).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, plain), np.int64, n)
        last = np.cumsum(sizes)
        first = last - sizes
        parts, start, end, score, gap = [], *(np.zeros(len(units), np.int64) for _ in range(4))
        if n:
            edges = self._matches(codes, first, last)
            best, second, back = self._forward(edges, first, last)
            _, begin, _, _, piece, _ = edges
            # back from the ends, all units at once
            unit, at, taken = np.arange(n), last, []
            while len(unit):
                e = back[at + unit]
                taken.append((unit, e))
                at = begin[e]
                on = at > first[unit]
                unit, at = unit[on], at[on]
            unit, e = (np.concatenate(x[::-1]) for x in zip(*taken))
            order = np.argsort(unit, kind="stable")
            unit, e = unit[order], e[order]
            spelled = piece[e] < 0
            code = codes[begin[e]]
            size = np.where(spelled, _utf8_size(code), 1)
            ids = np.repeat(piece[e], size).astype("<u2")
            raw = code[spelled].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            ids[np.repeat(spelled, size)] = np.array(self.single, "<u2")[np.frombuffer(raw, np.uint8)]
            parts.append(ids)
            where = np.delete(np.arange(len(units)), marked) if marked else slice(None)
            end[where] = np.cumsum(np.bincount(unit, size, n)).astype(np.int64)
            start[where] = np.r_[0, end[where][:-1]]
            place = last + np.arange(n)
            score[where] = best[place]
            gap[where] = np.where(second[place] > _NEVER // 2, best[place] - second[place], -1)
        made = len(parts[0]) if parts else 0
        for i in marked:
            two = self.paths(units[i], 2)
            parts.append(np.array(two[0][1], "<u2"))
            start[i], end[i], score[i] = made, made + len(parts[-1]), two[0][0]
            gap[i] = two[0][0] - two[1][0] if len(two) > 1 else -1
            made = int(end[i])
        return np.concatenate(parts), start, end, score, gap

    def segmentations(self, unit: str) -> list[tuple[int, bytes]]:
        """The N best segmentations of a unit: what each costs more than the best, and its ids."""
        found = self.lists.get(unit)
        if found is None:
            paths = self.paths(unit, self.nbest)
            found = [(paths[0][0] - s, np.array(ids, "<u2").tobytes()) for s, ids in paths]
            if len(unit) <= CACHED_CHARS:
                if len(self.lists) >= CACHE:
                    self.lists.clear()
                self.lists[unit] = found
        return found

    def stretches(self, text: str):
        """Units of a text, in lists of about ``STRETCH_CHARS`` characters."""
        at = 0
        while at < len(text):
            cut = _BREAK.search(text, at + STRETCH_CHARS)
            end = cut.end() - 1 if cut else len(text)
            yield self.unit.findall(text, at, end)
            at = end

    def _joined(self, parts: list[list[str]]) -> list[tuple[bytes, int, list[tuple[int, int, int, str]]]]:
        """Of texts given by their units: ids, score, and the units whose second choices cost least, with that cost
        and where their ids start and end."""
        flat = list(itertools.chain.from_iterable(parts))
        index = {u: i for i, u in enumerate(dict.fromkeys(flat))}
        names = list(index)
        which = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        data, start, end, score, gap = self.segment(names)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(counts) - counts
        size = (end - start)[which]
        ends = np.cumsum(size)
        ids = data[np.repeat(start[which] - (ends - size), size) + np.arange(int(ends[-1]))].tobytes()
        total = np.add.reduceat(score[which], first).tolist()
        text, cost = np.repeat(np.arange(len(parts)), counts), gap[which]
        at = np.flatnonzero(cost >= 0)
        at = at[np.argsort((text[at] << 40) + np.minimum(cost[at], (1 << 40) - 1), kind="stable")]
        lead = np.searchsorted(text[at], np.arange(len(parts) + 1)).tolist()
        bounds, starts = np.r_[0, ends[first + counts - 1]] * 2, (ends - size) * 2
        out = []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            # further ones cannot be among the N best: there are as many cheaper ones
            cheap = at[lead[i]:min(lead[i + 1], lead[i] + self.nbest - 1)]
            out.append((ids[a:b], total[i], [(int(cost[j]), int(starts[j]) - a, int(ends[j]) * 2 - a, flat[j]) for j in cheap.tolist()]))
        return out

    def _nbest_of(self, ids: bytes, total: int, cheap: list[tuple[int, int, int, str]]) -> tuple[list[bytes], list[int]]:
        """Ids and scores of the N best of a whole text: the A* goes on backward from unit to unit. What lies
        before a unit costs what the forward pass found, so a state's score is that of its best completion. Units
        not in ``cheap`` keep their best segmentation in all N best and are passed at once."""
        cheap = sorted(cheap)[:self.nbest - 1]
        further = [[x for x in self.segmentations(unit) if x[1] != ids[a:b]][:self.nbest - 1] for _, a, b, unit in cheap]
        heap: list[tuple] = [(-total, 0, len(cheap), None)]
        built, scores, made = [], [], 0
        while heap and len(scores) < self.nbest:
            cost, _, j, other = heapq.heappop(heap)
            if not j:
                built.append(self._replaced(ids, other))
                scores.append(-cost)
                continue
            _, a, b, _ = cheap[j - 1]
            # of equal costs the last one made is opened first: the best segmentation of the unit
            for more, cut in [*reversed(further[j - 1]), (0, None)]:
                made -= 1
                heapq.heappush(heap, (cost + more, made, j - 1, other if cut is None else (a, b, cut, other)))
        return built, scores

    @staticmethod
    def _replaced(ids: bytes, other: tuple | None) -> bytes:
        """The best ids with those of some units replaced, which are linked to one another."""
        places = []
        while other is not None:
            places.append(other[:3])
            other = other[3]
        out, at = [], 0
        for a, b, cut in sorted(places):
            out += [ids[at:a], cut]
            at = b
        return b"".join([*out, ids[at:]]) if places else ids

    def nbest_texts(self, texts: list[str]) -> list[tuple[list[bytes], list[int]]]:
        """Ids and scores of the N best segmentations of each whole text, the best first."""
        short = [i for i, t in enumerate(texts) if 0 < len(t) <= STRETCH_CHARS]
        found = self._joined([self.unit.findall(" " + texts[i]) for i in short]) if short else []
        out: list[tuple[list[bytes], list[int]]] = [([b""], [0])] * len(texts)
        for i, one in zip(short, found):
            out[i] = self._nbest_of(*one)
        for i, t in enumerate(texts):
            if len(t) > STRETCH_CHARS:
                parts, cheap, at = [], [], 0
                for units in self.stretches(" " + t):
                    ids, total, some = self._joined([units])[0]
                    parts.append((ids, total))
                    cheap += [(cost, a + at, b + at, unit) for cost, a, b, unit in some]
                    at += len(ids)
                cheap = heapq.nsmallest(self.nbest, cheap)
                out[i] = self._nbest_of(b"".join(p[0] for p in parts), sum(p[1] for p in parts), cheap)
        return out

    def texts(self, texts: list[str]) -> list[tuple[bytes, list[int]]]:
        """Ids of the best segmentation of each whole text, and the scores of its N best."""
        return [(ids[0], scores) for ids, scores in self.nbest_texts(texts)]

    def text(self, text: str) -> tuple[bytes, list[int]]:
        return self.texts([text])[0]


class Decoder:
    def __init__(self, pieces: dict[str, int], single: list[int]):
        self.value = {i: p for p, i in pieces.items()}
        self.byte = {i: b for b, i in enumerate(single)}

    def decode(self, ids) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "surrogatepass"))
                raw.clear()
            out.append(self.value[i].replace(MARK, " "))
        out.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(out)[1:]


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = MODEL,
           nbest: int = NBEST) -> DataFrame:
    """``doc_id, ids`` (little-endian 16-bit) of the best segmentation of each whole text, ``n_pieces``,
    ``scores`` of the N best, highest first, and ``further``, the ids of the second best and so on. The
    vocabulary is broadcast; it is fixed in size."""
    pieces, single = read_vocabulary(model)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, single, vars(Trie(pieces, _scores(pieces)))))

    def run(batches):
        trie = Trie.__new__(Trie)
        vars(trie).update(shared.value[2])
        lattice = Lattice(*shared.value[:2], nbest, trie)
        for piece in slices(batches, size=SLICE):
            found = lattice.nbest_texts([t or "" for t in piece.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([f[0][0] for f in found], pa.binary()),
                 pa.array([len(f[0][0]) // 2 for f in found], pa.int64()),
                 pa.array([[x / SCALE for x in f[1]] for f in found], pa.list_(pa.float64())),
                 pa.array([f[0][1:] for f in found], pa.list_(pa.binary()))],
                names=["doc_id", "ids", "n_pieces", "scores", "further"])
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        frugal(run), "doc_id long, ids binary, n_pieces long, scores array<double>, further array<binary>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def run(batches):
        lattice = Decoder(*shared.value)
        for piece in slices(batches, "ids"):
            texts = [lattice.decode(np.frombuffer(x or b"", "<u2").tolist()) for x in piece.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), "doc_id long, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_pieces, best_score, scores, ids_sha256`` of encoded texts, and ``nbest_sha256`` of the ids of
    each of the N best."""
    return encoded.select("doc_id", "n_pieces", F.get("scores", F.lit(0)).alias("best_score"), "scores",
                          F.sha2("ids", 256).alias("ids_sha256"),
                          F.transform(F.concat(F.array("ids"), "further"), lambda x: F.sha2(x, 256)).alias("nbest_sha256"))
