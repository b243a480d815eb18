"""Keyword search: BM25 over the text index, for a whole table of questions at once.

Every search is first turned into *weighted terms*, rows of ``qid, grp, field, term, df, top, w,
avgdl``. The score of an article within one ``grp`` is the sum over its matching terms of ``w``
times the article's share of the term; an article's final score is the best of its groups. One group
per field gives the best-field search, one group for all fields the additive boolean search.

Counted and found small, the terms go to the blocks of their parts; their postings are shuffled once,
by article, and added up in sparse blocks of bounded memory. Where the terms have many postings, two
rounds go before. The first reads the heaviest block of each term: the k-th best sum found is a lower
bound of a question's result. Terms that together stay below it cannot lift an article into the
result. The second round adds up the others, the *deciding* terms, without blocks and postings that
stay below the bound even beside the heaviest postings of all other terms; articles that can still
reach the bound are the candidates. The last round reads only the blocks that candidates lie in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import tokens
from ..session import BROADCAST_LIMIT_BYTES, byte_size, cut, needed, parallel, pieces_of, sized
from ..sources.tables import union_all
from .lexical_index import BLOCK, LexicalIndex, growth, posting_rows, share, tier_block
from .topk import best_rows, whole

# Fixed values of the field weights.
TITLE_WEIGHT = 3.0
FIELD_WEIGHTS = {"title": TITLE_WEIGHT, "text": 1.0}
SCORE_DIGITS = 6
ARTICLES_PER_QUESTION = 2
PAGE_SIZE = 10

# Above this many (question term, posting) pairs the search prunes before it scores.
PRUNE_ABOVE_PAIRS = 200_000_000
# Tiers of blocks that a term's postings of one part can fill.
TIERS = 22
# Postings a question may read to find its first lower bound.
SEED_POSTINGS = 100_000
# One salt of a frequent term holds at most this many postings.
SALT_POSTINGS = 1_000_000
# Terms treated as frequent hold at least 1/MAX_FREQUENT_TERMS of all postings each,
# so there are at most MAX_FREQUENT_TERMS of them.
MAX_FREQUENT_TERMS = 200_000

# Passes of a search whose terms are too many for one broadcast, and rows of them that one pass takes. Beyond
# that many passes terms and postings are joined.
MOST_PASSES = 256
# Impacts a task adds at once, and postings that one task of a search gets.
BLOCK_IMPACTS = 4_000_000
TASK_POSTINGS = 1_000_000
# Question terms a posting is met by, on average, from which on postings are dealt into slabs; articles of a
# slab, every how many slabs one is searched first, for bounds, and into how many pieces that one is cut.
SLAB_USES = 8
SLAB_ARTICLES = 1 << 14
FIRST_SLABS = 16
FIRST_PIECES = 8
# Bytes of a question term in a broadcast of a pass, and the part of a question's bound that the terms which do
# not decide may add up to: with less of it more is added up and fewer articles are completed.
ENTRY_BYTES = 64
LEFT_SHARE = 0.5
# Cells and impacts of one step in a slab, and hits kept before they are cut to the best. The terms that one in
# so many articles of a slab has are held as whole rows.
SLAB_CELLS = 250_000
SLAB_IMPACTS = 250_000
ROW_TERMS = 16
SLAB_HITS = 1_000_000

_WEIGHTED = ["qid", "grp", "field", "term", "w", "avgdl", "top"]


def question_terms(questions: DataFrame, fields=tuple(FIELD_WEIGHTS)) -> DataFrame:
    """(qid, field, term): distinct terms of each question, once per field."""
    return (questions
            .select("qid", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
            .select("qid", F.explode(F.array(*map(F.lit, fields))).alias("field"), "term"))


def weigh_terms(terms: DataFrame, index: LexicalIndex, weights: dict[str, float],
                additive: bool = False) -> DataFrame:
    """Attach df, field statistics and the weight ``boost * idf``. Unknown terms drop out."""
    def by_field(values) -> Column:
        return F.create_map(*[F.lit(x) for pair in zip(weights, values) for x in pair])[F.col("field")]

    groups = [0] * len(weights) if additive else range(len(weights))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    few = sized(terms, ["qid", "field", "term"])  # then the frequencies are scanned in place
    return (few.join(index.doc_freq, ["field", "term"])
            .join(F.broadcast(index.stats), "field")  # one row per field
            .select("qid", by_field(groups).alias("grp"), "field", "term", "df", "top",
                    (by_field(weights.values()) * idf).alias("w"), "avgdl"))


def _impact() -> Column:
    return F.col("w") * share(F.col("tf"), F.col("dl"), F.col("avgdl"))


def _match(terms: DataFrame, index: LexicalIndex) -> DataFrame:
    """Weighted terms, too many to broadcast, joined to their postings: one row per (question term,
    article). Terms frequent enough to overload a task are salted by article.
    """
    rows = terms.select(*_WEIGHTED)
    total = index.doc_freq.agg(F.sum("df").alias("total")).scalar()
    frequent = (index.doc_freq
                .where((F.col("df") > SALT_POSTINGS) & (F.col("df") * MAX_FREQUENT_TERMS >= total))
                .select("field", "term", F.ceil(F.col("df") / SALT_POSTINGS).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    spread = (index.postings.join(F.broadcast(frequent), ["field", "term"], "left")
              .withColumn("salt", F.pmod(F.xxhash64("article_id"), salts).cast("int")).drop("salts"))
    copies = (rows.join(F.broadcast(frequent), ["field", "term"], "left")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts"))
    return spread.join(copies, ["field", "term", "salt"])


def _impacts(matches: DataFrame) -> DataFrame:
    return matches.select("qid", "grp", "article_id", _impact().alias("impact"))


def _best_group(impacts: DataFrame, groups: int) -> DataFrame:
    """(qid, article_id, raw): sum of impacts per group, then the best group.

    One aggregate with a sum per group.
    """
    sums = [F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("impact"))), F.lit(0.0)) for g in range(groups)]
    if groups == 1:
        sums = [F.sum("impact")]
    return (impacts.groupBy("qid", "article_id")
            .agg(*[s.alias(f"sum{g}") for g, s in enumerate(sums)])
            .select("qid", "article_id",
                    (F.greatest(*[f"sum{g}" for g in range(groups)]) if groups > 1 else F.col("sum0")).alias("raw")))


def _keep_best(scored: DataFrame, k: int, order: Column) -> DataFrame:
    window = W.partitionBy("qid").orderBy(order.desc(), F.col("article_id").asc())
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _pruned(terms: DataFrame, index: LexicalIndex, k: int, groups: int, worth_pairs: float | None) -> DataFrame:
    """Impacts of every article that can reach the best ``k``, complete where it matters.

    1. The rarest terms of a question give some articles a partial score; the k-th of them is a
       lower bound for the final k-th.
    2. Terms of a group whose weights together stay below that bound cannot lift an article
       into the result (an impact never exceeds its weight). Only the other terms, the
       *deciding* ones, produce candidates.
    3. Candidates that can still reach the bound get the impacts of the group's remaining terms
       by an equi join on (article, field, term).

    Long postings of common words are thus met by few candidates instead of by every question.
    If the deciding terms touch more than ``worth_pairs`` postings, nothing is gained and all
    terms are matched after all.
    """
    rare_first = W.partitionBy("qid").orderBy("df", "grp", "field", "term")
    seeds = (terms
             .withColumn("seen", F.sum("df").over(rare_first.rowsBetween(W.unboundedPreceding, 0)))
             .withColumn("nth", F.row_number().over(rare_first))
             .where((F.col("nth") == 1) | (F.col("seen") <= SEED_POSTINGS)))
    first = _keep_best(_best_group(_impacts(_match(seeds, index)), groups), k, F.col("raw"))
    # a margin below the bound keeps articles that tie with the k-th once scores are rounded
    bound = first.where(F.col("rank") == k).select("qid", (F.col("raw") - 10.0 ** -(SCORE_DIGITS - 1)).alias("bound"))
    light_first = (W.partitionBy("qid", "grp").orderBy("w", "field", "term")
                   .rowsBetween(W.unboundedPreceding, 0))
    split = cut(terms.join(bound, "qid", "left")
                .withColumn("below", F.sum("w").over(light_first))
                .withColumn("decides", F.coalesce(F.col("below") >= F.col("bound"), F.lit(True))))
    if worth_pairs is not None:
        left = split.where("decides").agg(F.sum("df").alias("pairs")).first()["pairs"] or 0
        if left > worth_pairs:
            return _impacts(_match(terms, index))
    deciding, rest = split.where("decides"), split.where("NOT decides").select(*_WEIGHTED)
    limits = split.groupBy("qid", "grp").agg(
        F.max("bound").alias("bound"),
        F.coalesce(F.max(F.when(~F.col("decides"), F.col("below"))), F.lit(0.0)).alias("rest_w"))
    partial = (_impacts(_match(deciding, index))
               .groupBy("qid", "grp", "article_id").agg(F.sum("impact").alias("impact")))
    candidates = cut(partial.join(limits, ["qid", "grp"])
                     .where(F.col("bound").isNull() | (F.col("impact") + F.col("rest_w") >= F.col("bound")))
                     .select("qid", "grp", "article_id", "impact"))
    asked = rest.select("field", "term").distinct()
    common = index.postings.join(asked, ["field", "term"], "left_semi")
    added = _impacts(candidates.drop("impact").join(rest, ["qid", "grp"])
                     .join(common, ["article_id", "field", "term"]))
    return candidates.unionByName(added)


class _Asked:
    """The (counted, bounded) weighted terms of a search, as arrays.

    Terms are numbered; entries are the (question, group) cells a term counts in.
    """

    #: Part of the bound below which the sum of the terms that do not decide stays.
    left = 1.0

    def __init__(self, table: pa.Table, groups: int):
        names = list(zip(*(table.column(c).to_pylist() for c in ("field", "term"))))
        self.names = list(dict.fromkeys(names))
        number = {key: i for i, key in enumerate(self.names)}
        self.term = np.array([number[key] for key in names], np.int64)
        qids = whole(table.column("qid")).dictionary_encode()
        self.qids, self.groups = qids.dictionary, groups
        self.cell = table.column("grp").to_numpy().astype(np.int64) * len(self.qids) + qids.indices.to_numpy()
        self.w = table.column("w").to_numpy()
        self.top, self.avgdl, self.df = (np.empty(len(self.names)) for _ in range(3))
        for name in ("top", "avgdl", "df"):
            getattr(self, name)[self.term] = table.column(name).to_numpy()
        self.hash = np.empty(len(self.names), np.int64)
        self.hash[self.term] = table.column("hash").to_numpy()
        self.floor, self.decides = np.zeros(len(names)), np.ones(len(names), bool)
        self.bound = np.full(len(self.qids), -np.inf)
        self.slack = np.zeros(groups * len(self.qids))

    def set_bounds(self, found: pa.Table, k: int) -> None:
        """Take the k-th best sums of the first round (``qid, score``) as bounds."""
        place = {q: i for i, q in enumerate(self.qids.to_pylist())}
        scores: dict[int, list[float]] = {}
        for q, score in zip(found.column("qid").to_pylist(), found.column("score").to_pylist()):
            scores.setdefault(place[q], []).append(score)
        for q, mine in scores.items():
            if len(mine) >= k:
                # rounding, and ties with the k-th, stay above the bound
                self.bound[q] = sorted(mine, reverse=True)[k - 1] - 10.0 ** -(SCORE_DIGITS - 1)
        heaviest, bound = self.w * self.top[self.term], self.bound[self.cell % len(self.qids)]
        order = np.lexsort((heaviest, self.cell))  # the light terms of each cell first
        running = np.cumsum(heaviest[order])
        first = np.r_[True, np.diff(self.cell[order]) != 0]
        before = np.maximum.accumulate(np.where(first, running - heaviest[order], -np.inf))
        self.decides = np.empty(len(order), bool)
        self.decides[order] = running - before >= self.left * bound[order]
        self.slack = np.bincount(self.cell[~self.decides], heaviest[~self.decides], len(self.slack))
        rest = np.bincount(self.cell, heaviest, len(self.slack))[self.cell] - heaviest
        self.floor = np.clip((bound - rest) / self.w - 1e-8, 0, 2)

    def needed(self, deciding: bool = False) -> list[tuple[int, int, str, str, float]]:
        """Number, hash, field, term and lowest floor of the (deciding) terms."""
        least = np.full(len(self.names), np.inf)
        used = self.decides if deciding else slice(None)
        np.minimum.at(least, self.term[used], self.floor[used] if deciding else 0.0)
        return [(i, int(self.hash[i]), *self.names[i], float(least[i])) for i in np.flatnonzero(least <= self.top).tolist()]

    def arrays(self, deciding: bool = False) -> tuple:
        """Entries by term, of each term those with low floors first."""
        floor = self.floor if deciding else np.zeros(len(self.floor))
        order = np.lexsort((floor, self.term))
        order = order[self.decides[order]] if deciding else order
        key = self.term[order] * 4.0 + floor[order]
        begin = np.searchsorted(self.term[order], np.arange(len(self.names) + 1))
        limits = (self.slack, self.bound) if deciding else None
        return self.qids, self.groups, begin, key, self.cell[order], self.w[order], self.avgdl, limits


def _sums(asked: tuple, number: np.ndarray, share_: np.ndarray, article: np.ndarray, n: int
          ) -> tuple[np.ndarray, np.ndarray]:
    """Sums by (cell, article) of whole articles' postings: places ``cell * n + article`` in order,
    and their totals. Memory follows the matches."""
    qids, groups, begin, key, cell, w, *_ = asked
    copies = np.searchsorted(key, number * 4.0 + share_, side="right") - begin[number]
    posting = np.repeat(np.arange(len(number)), copies)
    entry = np.arange(len(posting)) - np.repeat(np.cumsum(copies) - copies, copies) + begin[number][posting]
    impact, size = w[entry] * share_[posting], groups * len(qids) * n
    place = cell[entry] * n + article[posting]
    if size <= 4 * len(place):
        total = np.bincount(place, impact, size)
        place = np.flatnonzero(total)
        return place, total[place]
    order = np.argsort(place, kind="stable")
    place, impact = place[order], impact[order]
    first = np.flatnonzero(np.r_[True, np.diff(place) != 0]) if len(place) else np.zeros(0, np.int64)
    return place[first], np.add.reduceat(impact, first) if len(first) else impact


def _best_of(asked: tuple, place: np.ndarray, total: np.ndarray, articles: pa.Array, k: int) -> pa.Table:
    """Best ``k`` articles of each question (``q, id, score``): of each article its best group."""
    n, questions = len(articles), len(asked[0])
    place = place % (questions * n)
    if asked[1] > 1 and len(place):
        order = np.argsort(place, kind="stable")
        place, total = place[order], total[order]
        first = np.flatnonzero(np.r_[True, np.diff(place) != 0])
        place, total = place[first], np.maximum.reduceat(total, first)
    total = np.rint(total * 10.0 ** SCORE_DIGITS) / 10.0 ** SCORE_DIGITS
    return best_rows(pa.table({"q": pa.array(place // n, pa.int64()), "id": articles.take(pa.array(place % n)),
                               "score": total}), k)


def _needed_blocks(wanted: list[tuple], index: LexicalIndex, seeds: bool = False,
                   places: DataFrame | None = None) -> list[tuple]:
    """(segment, its blocks that can matter): by part, term and block maximum, and with ``places``
    (``block``) by the blocks that candidates lie in."""
    spark = index.doc_freq.sparkSession
    if not wanted:
        return []
    number, hashes, field, term, floor = (list(x) for x in zip(*wanted))
    table = spark.createDataFrame(pa.table({"number": pa.array(number, pa.int32()), "field": field, "term": term, "floor": floor}))
    # a block maximum may lie too low only where later segments changed the mean lengths
    means = {r["field"]: r["avgdl"] for r in index.stats.collect()} if len(index.segments) > 1 else {}
    out = []
    for segment in index.segments:
        parts = {h % segment.parts for h in hashes}
        asked = [s * segment.parts + p for s in range(segment.slices) for p in sorted(parts)]
        blocks = segment.blocks
        if len(asked) < segment.parts * segment.slices:
            blocks = blocks.where(F.col("part").isin(asked))
        if seeds:
            blocks = blocks.where("block = 0")
        top = F.col("top")
        if means:
            top = top * F.create_map(*[F.lit(x) for pair in growth(segment, means).items() for x in pair])[F.col("field")]
        blocks = blocks.join(F.broadcast(table), ["field", "term"]).where(top >= F.col("floor"))
        if places is not None:
            blocks = blocks.join(sized(places, ["block"]), "block", "left_semi")
        out.append((segment, blocks))
    return out


def _whole_articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables cut between articles, of batches sorted by ``article_id``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column(0)
        if not len(ids):
            continue
        codes = pc.run_end_encode(ids)
        if held and held[-1].column(0)[-1].as_py() != ids[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        start = codes.run_ends[-2].as_py() if len(codes.run_ends) > 1 else 0
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _added_up(asked: _Asked, index: LexicalIndex, k: int, found: list[tuple], postings_: float, schema: str,
              deciding: bool = False, keep: DataFrame | None = None) -> DataFrame:
    """Sum the postings of the blocks ``found``: (qid, article_id, score), the best ``k`` of each task,
    or with ``deciding`` the candidates (article_id)."""
    spark = index.doc_freq.sparkSession
    if not found:
        return spark.createDataFrame([], schema)
    rows = union_all([index.live(segment, posting_rows(blocks, "number")) for segment, blocks in found])
    rows = rows.select("article_id", "number", F.col("dl").cast("int").alias("dl"), F.col("tf").cast("int").alias("tf"))
    if keep is not None:
        rows = rows.join(sized(keep, ["article_id"]), "article_id", "left_semi")
    tasks = max(parallel(spark), pieces_of(postings_, TASK_POSTINGS))
    dealt = rows.repartition(tasks, "article_id").sortWithinPartitions("article_id")
    sent = spark.sparkContext.broadcast(asked.arrays(deciding))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value
        questions, begin, mean, limits = value[0], value[2], value[6], value[7]
        best = None
        for table in _whole_articles(batches):
            codes = whole(table.column("article_id")).dictionary_encode()
            article = codes.indices.to_numpy().astype(np.int64)
            number = table.column("number").to_numpy().astype(np.int64)
            tf, dl = (table.column(c).to_numpy().astype(np.float64) for c in ("tf", "dl"))
            weight = share(tf, dl, mean[number])
            # steps of whole articles and a bounded number of impacts
            first = np.flatnonzero(np.r_[True, article[1:] != article[:-1]])
            work = np.add.reduceat(begin[number + 1] - begin[number], first).cumsum()
            at = 0
            while at < len(first):
                end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + BLOCK_IMPACTS)))
                lo, hi = first[at], first[end] if end < len(first) else len(number)
                low, at = int(article[lo]), end
                names = codes.dictionary.slice(low, int(article[hi - 1]) - low + 1)
                place, total = _sums(value, number[lo:hi], weight[lo:hi], article[lo:hi] - low, len(names))
                if limits is not None:
                    cell = place // len(names)
                    reach = total + limits[0][cell] >= limits[1][cell % len(questions)]
                    some = np.unique(place[reach] % len(names))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(some))], ["article_id"])
                    continue
                new = _best_of(value, place, total, names, k)
                best = new if best is None else best_rows(pa.concat_tables([best, new]), k)
        if best is not None:
            out = pa.table({"qid": questions.take(whole(best.column("q"))), "article_id": best.column("id"),
                            "score": best.column("score")})
            yield from out.to_batches(max_chunksize=100_000)

    return dealt.mapInArrow(run, f"article_id {index.articles.schema['article_id'].dataType.simpleString()}" if deciding else schema)


def _candidates(asked: _Asked, index: LexicalIndex, k: int, schema: str) -> DataFrame | None:
    """Articles that can reach the best ``k`` of a question; none where the deciding terms touch more
    than half of all postings anyway."""
    seeds = _added_up(asked, index, k, _needed_blocks(asked.needed(), index, seeds=True),
                      np.minimum(asked.df, BLOCK).sum(), schema)
    asked.set_bounds(_keep_best(seeds, k, F.col("score")).select("qid", "score").toArrow(), k)
    deciding = asked.df[np.unique(asked.term[asked.decides])].sum()
    if deciding > 0.5 * asked.df.sum():
        return None
    found = _needed_blocks(asked.needed(deciding=True), index)
    return cut(_added_up(asked, index, k, found, deciding, schema, deciding=True).distinct())


def _candidate_blocks(candidates: DataFrame) -> DataFrame:
    """(block): where in the tiers of any term a candidate can lie."""
    tiers = F.explode(F.sequence(F.lit(-1), F.lit(TIERS))).alias("tier")
    return candidates.select("article_id", tiers).select(tier_block(F.col("tier")).alias("block")).distinct()


def _fetched(terms: DataFrame, limit: int) -> pa.Table | None:
    """The weighted terms, unless they take more than ``limit`` bytes."""
    rows = limit // 128  # of the columns and of what is made of them
    # counted first: a limit would send as many rows from every partition to one task
    size = terms.agg(F.count("*").alias("rows"), byte_size("qid", "field", "term").alias("bytes")).first()
    if size["rows"] > rows or size["bytes"] > limit:
        return None
    table = terms.select(*_WEIGHTED, "df", F.xxhash64("field", "term").alias("hash")).toArrow()
    return table if table.nbytes <= limit else None


def _posting_count(table: pa.Table) -> int:
    """Postings of the different terms."""
    each = table.select(["field", "term", "df"]).group_by(["field", "term"]).aggregate([("df", "max")])
    return pc.sum(each.column("df_max")).as_py() or 0


def _result_schema(terms: DataFrame, index: LexicalIndex) -> str:
    types = (terms.schema["qid"].dataType.simpleString(), index.articles.schema["article_id"].dataType.simpleString())
    return f"qid {types[0]}, article_id {types[1]}, score double"


def _small_search(table: pa.Table, schema: str, index: LexicalIndex, k: int, groups: int, prune: bool) -> DataFrame:
    """(qid, article_id, score) for terms that fit a broadcast."""
    if not table.num_rows:
        return index.doc_freq.sparkSession.createDataFrame([], schema)
    asked = _Asked(table, groups)
    candidates = _candidates(asked, index, k, schema) if prune else None
    if candidates is None:
        return _added_up(asked, index, k, _needed_blocks(asked.needed(), index), asked.df.sum(), schema)
    found = _needed_blocks(asked.needed(), index, places=_candidate_blocks(candidates))
    return _added_up(asked, index, k, found, asked.df.sum() / 2, schema, keep=candidates)


def _passes(terms: DataFrame, broadcast_limit: int) -> int | None:
    """How many groups of whole questions make each group's terms fit a broadcast; none where one
    question does not, or they are too many."""
    per = terms.groupBy("qid").agg((F.count("*") * ENTRY_BYTES).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    room = broadcast_limit - 8 * per["most"]  # groups by hash are uneven
    if room <= 0:
        return None
    passes = pieces_of(1.25 * per["all"], room)
    return passes if passes <= MOST_PASSES else None


class _Pass(_Asked):
    """The terms of a group of whole questions, by number; entries as in ``_Asked``, by cell."""

    left = LEFT_SHARE

    def __init__(self, table: pa.Table, groups: int):
        qids = whole(table.column("qid")).dictionary_encode()
        self.qids, self.groups = qids.dictionary, groups
        cell = table.column("grp").to_numpy().astype(np.int64) * len(self.qids) + qids.indices.to_numpy()
        order = np.argsort(cell, kind="stable")
        self.numbers, term, first = (x for x in _distinct(table.column("number").to_numpy()))
        self.cell, self.term = cell[order], term[order]
        self.w, self.top = table.column("w").to_numpy()[order], table.column("top").to_numpy()[first]
        self.floor, self.decides = np.zeros(len(order)), np.ones(len(order), bool)
        self.bound = np.full(len(self.qids), -np.inf)
        self.slack = np.zeros(groups * len(self.qids))

    def sent(self) -> dict:
        """What a task needs: the deciding entries, and the others, of each cell the heaviest first."""
        heavy = self.w * self.top[self.term]
        rest = np.flatnonzero(~self.decides)
        rest = rest[np.lexsort((-heavy[rest], self.cell[rest]))]
        out = {"qids": self.qids, "numbers": self.numbers, "bound": self.bound, "slack": self.slack}
        for name, chosen in (("deciding", np.flatnonzero(self.decides)), ("rest", rest)):
            out[name] = (self.cell[chosen].astype(np.int32), self.term[chosen].astype(np.int32), self.w[chosen])
        return out | {"floor": self.floor[self.decides], "heavy": heavy[rest],
                      "rest_begin": np.searchsorted(self.cell[rest], np.arange(len(self.slack) + 1))}


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order, the place of each value among them, and where each first stands."""
    found, first, place = np.unique(values, return_index=True, return_inverse=True)
    return found, place, first


def _slabs(names: DataFrame, index: LexicalIndex) -> tuple[int, DataFrame]:
    """(slab, ids, numbers, ends, at, shares): the postings of the terms ``names(number, field, term, avgdl, df)``,
    dealt by article. A row holds a slab: its articles, its terms, and of each term the places of its articles and
    their shares, the highest first. Also the number from which on slabs are to be searched first."""
    size = names.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    most = index.stats.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    slabs = max(pieces_of(size, TASK_POSTINGS), pieces_of(most, SLAB_ARTICLES))

    # slabs that are searched first are cut further, since there are few of them
    every, pieces = FIRST_SLABS, FIRST_PIECES

    def fine(article: Column) -> Column:
        return F.pmod(F.xxhash64(article), F.lit(slabs * pieces)).cast("int")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slab_of(fine: np.ndarray) -> np.ndarray:
            slab, piece = np.divmod(fine.astype(np.int64), pieces)
            return np.where(slab % every == 0, slabs + slab // every * pieces + piece, slab)
        return _deal(batches, slab_of)

    kind = index.articles.schema["article_id"].dataType.simpleString()
    wanted = sized(names.select("number", "field", "term", "avgdl"), ["number", "field", "term", "avgdl"])
    dealt = []
    for segment in index.segments:
        blocks = segment.blocks.join(wanted, ["field", "term"])
        if index.dead is None:
            rows = blocks.select("number", "avgdl", F.col("articles").alias("article_id"), F.col("dls").alias("dl"), F.col("tfs").alias("tf"),
                                 F.transform("articles", fine).alias("fine"))
        else:
            rows = index.live(segment, posting_rows(blocks, "number", "avgdl")).select(
                "number", "avgdl", "article_id", "dl", "tf", fine(F.col("article_id")).alias("fine"))
        dealt.append(rows.mapInArrow(deal, f"slab int, article_id array<{kind}>, number array<bigint>, share array<double>"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            yield _slab_of(pa.Table.from_batches(held))

    rows = union_all(dealt).repartitionById(slabs + pieces_of(slabs, every) * pieces, F.col("slab"))
    return slabs, cut(rows.mapInArrow(gather, f"slab int, ids array<{kind}>, numbers array<bigint>, ends array<int>, at array<int>, "
                                       "shares array<double>"))


def _deal(batches: Iterator[pa.RecordBatch], slab_of: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Postings, or blocks of them, as one row for each slab and ``SLAB_IMPACTS`` postings."""
    held, size = [], 0
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        if pa.types.is_list(columns["article_id"].type):
            row = pa.array(np.repeat(np.arange(len(batch)), columns["article_id"].value_lengths().to_numpy()))
            columns = {name: c.flatten() if pa.types.is_list(c.type) else c.take(row) for name, c in columns.items()}
        tf, dl, mean = (columns[c].to_numpy().astype(np.float64) for c in ("tf", "dl", "avgdl"))
        held.append(pa.table({"slab": slab_of(columns["fine"].to_numpy()), "article_id": columns["article_id"], "number": columns["number"],
                              "share": share(tf, dl, mean)}))
        size += len(tf)
        if size >= SLAB_IMPACTS:
            yield _dealt(held)
            held, size = [], 0
    if size:
        yield _dealt(held)


def _dealt(held: list[pa.Table]) -> pa.RecordBatch:
    table = pa.concat_tables(held).combine_chunks()
    slab = table.column("slab").to_numpy()
    order = np.argsort(slab, kind="stable")
    begin = np.flatnonzero(np.diff(slab[order], prepend=-1))
    table = table.take(pa.array(order))
    offsets = pa.array(np.r_[begin, len(order)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(slab[order][begin], pa.int32())] + [pa.ListArray.from_arrays(offsets, whole(table.column(c)))
                                                      for c in ("article_id", "number", "share")],
        ["slab", "article_id", "number", "share"])


def _slab_of(table: pa.Table) -> pa.RecordBatch:
    """The rows of one slab as one."""
    def flat(name):
        return pc.list_flatten(whole(table.column(name)))
    ids = flat("article_id").dictionary_encode()
    number, weight = flat("number").to_numpy(), flat("share").to_numpy()
    order = np.lexsort((-weight, number))
    number = number[order]
    ends = np.r_[np.flatnonzero(number[1:] != number[:-1]) + 1, len(number)]

    def one(values, kind):
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    return pa.RecordBatch.from_arrays(
        [table.column("slab").chunk(0).slice(0, 1), one(ids.dictionary, ids.dictionary.type), one(number[ends - 1], pa.int64()),
         one(ends, pa.int32()), one(ids.indices.to_numpy()[order], pa.int32()), one(weight[order], pa.float64())],
        ["slab", "ids", "numbers", "ends", "at", "shares"])


def _spread(count: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs ``lo, lo + 1, ...`` of ``count`` places: the run of each place, and the places."""
    run = np.repeat(np.arange(len(count)), count)
    return run, np.arange(len(run)) + (lo - (np.cumsum(count) - count))[run]


class _Slab:
    """A slab while a pass goes through it."""

    def __init__(self, batch: pa.RecordBatch, row: int, asked: dict):
        def values(name):
            return batch.column(name)[row].values
        self.ids = values("ids")
        self.at, self.shares = values("at").to_numpy().astype(np.int64), values("shares").to_numpy()
        numbers, ends = values("numbers").to_numpy(), values("ends").to_numpy().astype(np.int64)
        begin, self.n = np.r_[0, ends[:-1]], len(self.ids)
        # places of the asked terms among those of the slab, or -1
        place = np.minimum(np.searchsorted(numbers, asked["numbers"]), len(numbers) - 1)
        self.place = np.where(numbers[place] == asked["numbers"], place, -1)
        nth = np.repeat(np.arange(len(numbers)), ends - begin)
        _, term, _ = asked["deciding"]
        there = self.place[term]
        self.lo = begin[there]
        # the highest shares come first: those below an entry's floor are a tail
        end = np.searchsorted(nth * 4.0 + 2 - self.shares, there * 4.0 + 2 - asked["floor"], side="right")
        self.count = np.where(there >= 0, np.clip(end - self.lo, 0, None), 0)
        frequent = (ends - begin) * ROW_TERMS >= self.n
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.rows = np.zeros((int(frequent.sum()), self.n))
        held = frequent[nth]
        self.rows[self.row[nth[held]], self.at[held]] = self.shares[held]
        key = nth * self.n + self.at
        order = np.argsort(key)
        self.keys, self.by_key = key[order], self.shares[order]

    def share_of(self, term: np.ndarray, article: np.ndarray) -> np.ndarray:
        """The shares of articles in terms; 0 where a term is not in an article."""
        place = self.place[term]
        key = place * self.n + article
        row = np.where(place >= 0, self.row[place], -1)
        out = np.zeros(len(term))
        held, other = np.flatnonzero(row >= 0), np.flatnonzero((row < 0) & (place >= 0))
        out[held] = self.rows[row[held], article[held]]
        key = key[other]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[other] = np.where(self.keys[at] == key, self.by_key[at], 0.0)
        return out

    def best(self, asked: dict, k: int) -> pa.Table:
        """Best ``k`` articles of each question (``q, id, score``) that reach its bound."""
        questions = len(asked["qids"])
        cell, term, w = asked["deciding"]
        used = np.flatnonzero(self.count)
        cell, w, lo, count = cell[used].astype(np.int64), w[used], self.lo[used], self.count[used]
        row = self.row[self.place[term[used]]]
        count = np.where(row < 0, count, 0)
        as_rows = np.flatnonzero(row >= 0)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        work, ends = np.r_[0, np.cumsum(count)], np.r_[first[1:], len(cell)]
        kept, hits, a = [], 0, 0
        while a < len(first):
            b = int(np.searchsorted(work[ends], work[first[a]] + SLAB_IMPACTS, side="right"))
            b = max(a + 1, min(b, a + SLAB_CELLS // self.n, len(first)))
            cells = cell[first[a:b]]
            total = np.zeros((b - a) * self.n)
            at = first[a]
            while at < ends[b - 1]:
                to = max(at + 1, int(np.searchsorted(work, work[at] + 2 * SLAB_IMPACTS, side="right")) - 1)
                to = min(to, int(ends[b - 1]))
                run, posting = _spread(count[at:to], lo[at:to])
                start = np.searchsorted(cells, cell[at:to]) * self.n
                total += np.bincount(start[run] + self.at[posting], w[at:to][run] * self.shares[posting], len(total))
                at = to
            total = total.reshape(-1, self.n)
            of = as_rows[slice(*np.searchsorted(as_rows, [first[a], ends[b - 1]]))]
            for i, r, x in zip(np.searchsorted(cells, cell[of]).tolist(), row[of].tolist(), w[of].tolist()):
                total[i] += self.rows[r] * x
            found = self._reaching(asked, cells, total, k)
            if len(found[0]):
                kept.append(self._told(*found, questions))
                hits += len(found[0])
            if hits > SLAB_HITS:
                kept = [self._cut(kept, k)]
                hits = len(kept[0])
            a = b
        return self._cut(kept, k)

    def _reaching(self, asked: dict, cells: np.ndarray, total: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Cell, article and sum over all terms where it reaches the bound of the question; of a question
        without a bound, where it is among the best of the cell."""
        bound = asked["bound"][cells % len(asked["qids"])]
        least = bound - asked["slack"][cells]
        free = np.flatnonzero(np.isneginf(bound))
        if len(free) and self.n > k:
            # rounding, and ties with the k-th, stay above the limit
            least[free] = np.partition(total[free], self.n - k, axis=1)[:, self.n - k] - 10.0 ** -(SCORE_DIGITS - 1)
        found = np.flatnonzero((total >= least[:, None]) & (total > 0))
        row, article = found // self.n, found % self.n
        cell, score = cells[row], total.reshape(-1)[found]
        _, term, w = asked["rest"]
        begin, left, goal = asked["rest_begin"], asked["slack"][cell], bound[row]
        alive, nth = np.flatnonzero(begin[cell] < begin[cell + 1]), 0
        while len(alive):
            entry = begin[cell[alive]] + nth
            score[alive] += w[entry] * self.share_of(term[entry], article[alive])
            left[alive] -= asked["heavy"][entry]
            nth += 1
            on = (score[alive] + left[alive] >= goal[alive] - 1e-8) & (entry + 1 < begin[cell[alive] + 1])
            alive = alive[on]
        reached = np.flatnonzero(score >= goal)
        return cell[reached], article[reached], score[reached]

    def _told(self, cell: np.ndarray, article: np.ndarray, score: np.ndarray, questions: int) -> pa.Table:
        score = np.rint(score * 10.0 ** SCORE_DIGITS) / 10.0 ** SCORE_DIGITS
        return pa.table({"q": pa.array(cell % questions, pa.int64()), "at": pa.array(article, pa.int64()),
                         "id": self.ids.take(pa.array(article)), "score": score})

    @staticmethod
    def _cut(kept: list[pa.Table], k: int) -> pa.Table | None:
        """Of each article of a question its best group, and of them the best ``k``."""
        if not kept:
            return None
        table = pa.concat_tables(kept)
        q, at, score = (table.column(c).to_numpy() for c in ("q", "at", "score"))
        order = np.lexsort((-score, at, q))
        first = np.r_[True, (np.diff(q[order]) != 0) | (np.diff(at[order]) != 0)]
        return best_rows(table.take(pa.array(order[first])), k)


def _through_slabs(asked: _Pass, slabs: DataFrame, k: int, schema: str) -> DataFrame:
    """(qid, article_id, score): of each slab the best ``k`` of each question that reach its bound."""
    sent = slabs.sparkSession.sparkContext.broadcast(asked.sent())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                best = _Slab(batch, row, value).best(value, k)
                if best is not None:
                    yield from pa.table({"qid": value["qids"].take(whole(best.column("q"))), "article_id": best.column("id"),
                                         "score": best.column("score")}).to_batches(max_chunksize=100_000)

    return slabs.mapInArrow(run, schema)


def _search_in_passes(terms: DataFrame, index: LexicalIndex, k: int, groups: int, broadcast_limit: int,
                      passes: int) -> DataFrame | None:
    """(qid, article_id, score, rank): groups of whole questions go through stored slabs of the postings one after the
    other, each with its terms in a broadcast. None where a group turns out too large."""
    spark, schema, out = index.doc_freq.sparkSession, _result_schema(terms, index), []
    names = cut(terms.groupBy("field", "term").agg(F.max("df").alias("df"), F.max("top").alias("top"), F.max("avgdl").alias("avgdl"))
                .withColumn("number", F.monotonically_increasing_id()))
    known = sized(names.select("field", "term", "number"), ["field", "term", "number"])
    entries = cut(terms.select("qid", "grp", "field", "term", "w", "top").join(known, ["field", "term"])
                  .select(F.pmod(F.xxhash64("qid"), F.lit(passes)).cast("int").alias("pass"), "qid", "grp", "number", "w", "top"))
    sizes = {r["pass"]: r["count"] for r in entries.groupBy("pass").count().collect()}  # at most MOST_PASSES
    if max(sizes.values(), default=0) * ENTRY_BYTES > broadcast_limit:
        return None
    early, slabs = _slabs(names, index)
    for one in sorted(sizes):
        asked = _Pass(entries.where(F.col("pass") == one).toArrow(), groups)
        # the best articles of some slabs bound the result from below
        first = cut(_keep_best(_through_slabs(asked, slabs.where(F.col("slab") >= early), k, schema), k, F.col("score")).drop("rank"))
        asked.set_bounds(first.select("qid", "score").toArrow(), k)
        scored = first.unionByName(_through_slabs(asked, slabs.where(F.col("slab") < early), k, schema))
        # the hits of a pass are few; kept, they let go of its broadcasts
        out.append(cut(_keep_best(scored, k, F.col("score"))))
    return union_all(out) if out else spark.createDataFrame([], f"{schema}, rank int")


def block_counts(terms: DataFrame, index: LexicalIndex, k: int, groups: int = 1) -> dict[str, int]:
    """Blocks the terms of a search have, blocks read to find its candidates, and blocks the
    candidates lie in. Without candidates the search reads all."""
    table = _fetched(terms, BROADCAST_LIMIT_BYTES)
    if table is None or not table.num_rows:
        return {"all": 0, "deciding": 0, "last": 0}
    asked = _Asked(table, groups)
    candidates = _candidates(asked, index, k, _result_schema(terms, index))

    def count(found):
        return sum(blocks.count() for _, blocks in found)
    everything = count(_needed_blocks(asked.needed(), index))
    if candidates is None:
        return {"all": everything, "deciding": 0, "last": everything}
    return {"all": everything, "deciding": count(_needed_blocks(asked.needed(deciding=True), index)),
            "last": count(_needed_blocks(asked.needed(), index, places=_candidate_blocks(candidates)))}


def _numbered(terms: DataFrame, index: LexicalIndex, *how) -> DataFrame:
    """The search with numbers in place of names of any length."""
    names = cut(terms.select(F.col("qid").alias("name")).distinct())
    names = cut(names.withColumn("qid", F.monotonically_increasing_id()))
    keyed = terms.withColumnRenamed("qid", "name").join(sized(names, ["name", "qid"]), "name").drop("name")
    found = rank_articles(keyed, index, *how)
    return found.join(sized(names, ["name", "qid"]), "qid").select(F.col("name").alias("qid"), "article_id", "score", "rank")


def rank_articles(terms: DataFrame, index: LexicalIndex, k: int, groups: int = 1, prune: bool | None = None,
                  broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """(qid, article_id, score, rank): the best ``k`` articles of each question, exactly.

    ``groups`` is the number of ``grp`` values, counted from 0. ``prune=None`` decides by the number
    of postings the terms would touch.
    """
    table = _fetched(terms, broadcast_limit)
    pairs = terms.agg(F.sum("df").alias("n")).first()["n"] if table is None else pc.sum(table.column("df")).as_py()
    worth_pairs, many = None, table is None
    if prune is None and (pairs or 0) > PRUNE_ABOVE_PAIRS:
        prune, worth_pairs = True, pairs / 2
        many = many or pairs >= SLAB_USES * _posting_count(table)
    if many:
        if terms.schema["qid"].dataType.simpleString() == "string":
            return _numbered(terms, index, k, groups, prune if worth_pairs is None else None, broadcast_limit)
        terms = cut(terms)  # read by every step
        passes = _passes(terms, broadcast_limit)
        if passes is not None:
            found = _search_in_passes(terms, index, k, groups, broadcast_limit, passes)
            if found is not None:
                return found.select("qid", "article_id", "score", "rank")
    if table is not None:
        scored = _small_search(table, _result_schema(terms, index), index, k, groups, bool(prune))
    else:
        impacts = _pruned(terms, index, k, groups, worth_pairs) if prune else _impacts(_match(terms, index))
        scored = _best_group(impacts, groups).withColumn("score", F.round("raw", SCORE_DIGITS))
    return _keep_best(scored, k, F.col("score")).select("qid", "article_id", "score", "rank")


def match_text(questions: DataFrame, index: LexicalIndex, field: str = "text", k: int = PAGE_SIZE,
               **how) -> DataFrame:
    """Search one field."""
    terms = question_terms(questions, (field,))
    return rank_articles(cut(weigh_terms(terms, index, {field: 1.0})), index, k, **how)


def multi_match(questions: DataFrame, index: LexicalIndex, weights=None, k: int = PAGE_SIZE,
                **how) -> DataFrame:
    """Search several fields; the best weighted field counts."""
    weights = weights or FIELD_WEIGHTS
    terms = question_terms(questions, tuple(weights))
    return rank_articles(cut(weigh_terms(terms, index, weights)), index, k, groups=len(weights), **how)


def with_page_content(hits: DataFrame, index: LexicalIndex) -> DataFrame:
    """Attach ``page_content{title, text}`` to hits. The search runs once, the articles are scanned."""
    hits = cut(hits)
    return (hits.join(needed(index.articles, hits, "article_id"), "article_id")
            .select("qid", "article_id", "score", "rank",
                    F.struct("title", "text").alias("page_content")))


def lexical_retrieve(questions: DataFrame, index: LexicalIndex, k: int = ARTICLES_PER_QUESTION,
                     **how) -> DataFrame:
    """Retriever: questions (or comma lists of keywords) in, articles out."""
    return with_page_content(multi_match(questions, index, k=k, **how), index)
