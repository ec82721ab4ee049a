"""Exact top-k search: BM25 over a document-sharded inverted index with block-max WAND.

Document frequencies, the number of rows and the mean length are taken over the whole corpus, so scores
in all shards agree.  A query is a set of terms; for a document as query ("more like this") these are all
words of its whole text that another row has too (`query_terms` may cut them to those with the highest
tf * idf).  Only postings of query terms are shuffled, behind a bitmap of fixed size.

A shard's rows reach its task before the queries, which stream through it in batches, so a task holds
one shard and a batch of queries, however many there are.  Shards are gone through in rounds, each with its
own shuffle, whose files go when it ends: a copy of the queries for every shard at once would make disk grow
with the square of the corpus.  Each shard is still made once and sees every query.  Like documents stand together, in order of
length, in blocks.  The most frequent terms have their highest impact in every block; the postings of the
others are added up.  Both bound what a block can reach for a query, many queries at once as a product of
matrices.  The blocks with the highest bounds are scored first and give a threshold, blocks under it are
skipped, and the rest are scored for the queries that reach them.  Those scores are in 32 bits with a
margin for rounding; what they leave is scored exactly from the shard's forward lists.  The shards' top k
are merged.

Scores tie to the smaller id.  Defined cases: null and empty texts have no terms, are found by nothing
and find nothing; null ids are neither found nor queries; rows of equal id are found once, by the best
of them.  Queries of equal terms are run once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwarden.llm import bytetext
from tabwarden.llm.ppm import _Tally
from tabwarden.llm.tables import shared_folder, written

K1, B = 1.2, 0.75
BLOCK = 64
#: Slots of the bitmap of query terms that tasks carry.
BITS = 1 << 23
#: Postings of a shard, about: what a task holds, at some 30 bytes each.
SHARD = 8_000_000
#: Shards at least.
SHARDS = 6
#: The setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Postings that are worked on at once when a shard's index is made.
PIECE = 1 << 18
#: Blocks that are scored first.
PROBE = 16
#: Terms of a shard that count as frequent, at most; a block's documents times these stay under 65,536.
FREQUENT = 512
#: More than rounding to 32 bits changes a sum of so many impacts, as a share of it.
ROUNDING = 1e-4
#: Groups of like documents, and documents that they are learned from and dealt to at once.
GROUPS, ALIKE = 16, 2048
#: Queries that are worked on at once.
QUERIES = 256


def _documents(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(row, distinct terms, times, words) of each text with words."""
    for first, last, raw, offsets in bytetext.chunks(column):
        w = bytetext.words(raw, offsets, bytetext.NOT_ALPHANUMERIC)
        for i in range(last - first):
            own = w.hashes[w.first[i] : w.first[i + 1]]
            if len(own):
                terms, times = np.unique(own, return_counts=True)
                yield first + i, terms, times, len(own)


def statistics(docs: DataFrame) -> tuple[DataFrame, int, float]:
    """(text) -> ((term, df), rows, mean number of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, rows, words = _Tally(), 0, 0

        def out(kind, found):
            k, n = found
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, dtype=np.int8)), pa.array(k.view(np.int64)), pa.array(n)], names=["kind", "term", "n"])

        for batch in batches:
            rows += batch.num_rows
            pending: list[np.ndarray] = []
            for _, terms, _, size in _documents(batch.column("text")):
                words += size
                pending.append(terms)
                if len(pending) == 1024:
                    if (found := tally.add(np.concatenate(pending))) is not None:
                        yield out(0, found)
                    pending = []
            if pending and (found := tally.add(np.concatenate(pending))) is not None:
                yield out(0, found)
        yield out(0, tally.merged())
        yield out(1, (np.array([0, 1], dtype=np.uint64), np.array([rows, words])))

    found = written(docs.mapInArrow(run, "kind byte, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")), "terms")
    whole = {r["term"]: r["n"] for r in found.where("kind = 1").collect()}
    n, words = whole.get(0, 0), whole.get(1, 0)
    return found.where("kind = 0").select("term", F.col("n").alias("df")), n, words / max(1, n)


def _idf(n: int) -> Column:
    return F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def like_documents(docs: DataFrame, df: DataFrame, n: int, query_terms: int | None) -> DataFrame:
    """(doc_id, text) of the query rows -> (query_id, term, idf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, terms, times, _ in _documents(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.full(len(terms), row))), pa.array(terms.view(np.int64)), pa.array(times)], names=["query_id", "term", "tf"])

    terms = docs.mapInArrow(run, "query_id long, term long, tf long").join(df.where("df > 1"), "term").withColumn("idf", _idf(n))
    if query_terms is None:
        return terms.select("query_id", "term", "idf").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc(F.col("tf") * F.col("idf")), "term")
    return terms.withColumn("at", F.row_number().over(order)).where(F.col("at") <= query_terms).select("query_id", "term", "idf").distinct()


def _slots(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (terms & np.uint64(BITS - 1)).astype(np.int64), ((terms >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)


def postings(docs: DataFrame, terms: DataFrame, shards: int) -> DataFrame:
    """(doc_id, text) -> (shard, doc_id, length, terms, times): of each text's words the given terms, perhaps with some others."""
    each = terms.select(F.explode(F.array(F.expr(f"term & {BITS - 1}"), F.expr(f"shiftrightunsigned(term, 32) & {BITS - 1}"))).alias("slot"))
    bitmap = np.zeros(BITS, dtype=bool)
    bitmap[each.select(F.col("slot").cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            got: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            size = 0

            def out(batch=batch, got=got):
                ends = pa.array(np.cumsum([0, *(len(x[2]) for x in got)]).astype(np.int32))
                own, times = (np.concatenate([x[k] for x in got]) for k in (2, 3))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (own.view(np.int64), times.astype(np.int32))]
                rows = pa.array([x[0] for x in got])
                return pa.RecordBatch.from_arrays([batch.column("shard").take(rows), batch.column("doc_id").take(rows), pa.array([x[1] for x in got], pa.int64()), *lists], names=["shard", "doc_id", "length", "terms", "times"])

            for row, own, times, length in _documents(batch.column("text")):
                a, b = _slots(own)
                some = np.flatnonzero(bits[a] & bits[b])
                if not len(some):
                    continue
                got.append((row, length, own[some], times[some]))
                size += len(some)
                if size > 1 << 18:
                    yield out()
                    got.clear()
                    size = 0
            if got:
                yield out()

    # rows are dealt by their place, so that copies are spread
    dealt = docs.where("doc_id IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    return dealt.mapInArrow(run, "shard int, doc_id long, length long, terms array<long>, times array<int>")


class ShardIndex:
    """A shard's documents, like ones together: forward lists, postings by term, and each frequent term's impacts and highest impact in every block."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], mean: float):
        """pieces: (ids, lengths, numbers of terms, terms, times) of some documents each; the list is emptied, as what has an entry for each posting is as large as the shard."""
        columns = [list(x) for x in zip(*pieces, strict=True)]
        pieces.clear()
        times, terms = columns.pop(), columns.pop()
        ids, lengths, sizes = map(np.concatenate, columns)
        ends = np.cumsum(sizes)
        self.terms = np.unique(np.concatenate([np.unique(t) for t in terms]))
        numbers = np.empty(int(sizes.sum()), dtype=np.int32)
        _joined(terms, numbers, lambda t: np.searchsorted(self.terms, t))
        counts = np.bincount(numbers, minlength=len(self.terms))
        frequent = np.argsort(-counts, kind="stable")[:FREQUENT]
        frequent = frequent[counts[frequent] > BLOCK]
        self.column = np.full(len(self.terms), -1, dtype=np.int16)
        self.column[frequent] = np.arange(len(frequent))
        order = np.lexsort((ids, lengths, _alike(numbers, sizes, self.column, len(frequent))))
        self.ids, self.sizes = ids[order], sizes[order]
        self.ends = np.cumsum(self.sizes)
        times = _joined(times, np.empty(len(numbers), dtype=np.int32))
        self.part = np.empty(len(numbers))
        self.number = np.empty(len(numbers), dtype=np.int32)  # of the terms in forward order
        begin, norm = (ends - sizes)[order], K1 * (1 - B + B * lengths[order] / mean)
        for lo, hi in _steps(self.ends):
            at = _ranges(begin[lo:hi], begin[lo:hi] + self.sizes[lo:hi])
            to = slice(self.ends[lo] - self.sizes[lo], self.ends[hi - 1])
            tf = times[at].astype(np.float64)
            self.part[to] = tf * (K1 + 1) / (tf + np.repeat(norm[lo:hi], self.sizes[lo:hi]))
            self.number[to] = numbers[at]
        del numbers, times
        self.bounds = np.append(0, np.cumsum(np.bincount(self.number, minlength=len(self.terms))))
        self.doc, self.posted = _by_term(self.number, self.bounds, self.sizes, self.ends, self.part)
        self.blocks = -(-len(ids) // BLOCK)
        self.repeated = len(np.unique(ids)) < len(ids)
        self.skipped = 0  # blocks, each time that a query shares terms with one and its bound is too low
        # the impacts of frequent terms block by block: their places in a table of documents by terms
        self.often, self.often_part = np.empty(int(counts[frequent].sum()), dtype=np.uint16), np.empty(int(counts[frequent].sum()), dtype=np.float32)
        self.often_ends, self.highest = np.zeros(self.blocks + 1, dtype=np.int64), np.zeros((self.blocks, len(frequent)), dtype=np.float32)
        for block in range(self.blocks):
            lo, hi = block * BLOCK, min(len(ids), (block + 1) * BLOCK)
            own = slice(self.ends[lo] - self.sizes[lo], self.ends[hi - 1])
            column = self.column[self.number[own]]
            some = np.flatnonzero(column >= 0)
            to = slice(self.often_ends[block], self.often_ends[block] + len(some))
            self.often_ends[block + 1] = to.stop
            self.often[to] = np.repeat(np.arange(hi - lo), self.sizes[lo:hi])[some] * len(frequent) + column[some]
            self.often_part[to] = self.part[own][some]
            np.maximum.at(self.highest[block], column[some], self.often_part[to])
        self.highest = np.ascontiguousarray(self.highest.T)

    def block_max_wand(self, terms: np.ndarray, sizes: np.ndarray, idf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many were found for each query, ids, scores) of the k best documents by the sum of the terms' impacts; equal scores go to the smaller id.

        terms and idf: those of some queries in a row, sizes: how many each has.
        """
        queries = len(sizes)
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[place] == terms
        place, idf, query = place[here], idf[here], np.repeat(np.arange(queries), sizes)[here]
        column = self.column[place]
        often = column >= 0
        weights = np.zeros((queries, len(self.highest)), dtype=np.float32)
        weights[query[often], column[often]] = idf[often]
        sums = self._rare_sums(place[~often], idf[~often], query[~often], queries)
        tops = sums.reshape(queries, self.blocks, BLOCK).max(axis=2)
        bound = tops + weights @ self.highest
        bound *= 1 + ROUNDING
        # the likeliest blocks come first and give each query the score that the others' bounds must reach
        n = min(PROBE, self.blocks)
        likely = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(likely, np.argpartition(-bound, n - 1, axis=1)[:, :n], True, axis=1)
        shared = bound > 0
        first = self._reached(likely & shared, weights, sums, np.zeros(queries, dtype=np.float32))
        least, cuts = np.zeros(queries, dtype=np.float32), np.searchsorted(first[0], np.arange(queries + 1))
        for q in range(queries):
            some = slice(cuts[q], cuts[q + 1])
            least[q] = self._threshold(self.ids[first[1][some]], first[2][some], k) * (1 - 3 * ROUNDING)
        live = shared & ~likely & (bound >= least[:, None])
        self.skipped += int(np.count_nonzero(shared & ~likely & ~live))
        of, docs, upper = (np.concatenate(x) for x in zip(first, self._reached(live, weights, sums, least), strict=True))
        some = np.flatnonzero(upper >= least[of])
        some = some[np.argsort(of[some], kind="stable")]
        of, docs, upper = of[some], docs[some], upper[some]
        weight, ends = np.zeros(len(self.terms)), np.searchsorted(query, np.arange(queries + 1))
        found, cuts = [], np.searchsorted(of, np.arange(queries + 1))
        for q in range(queries):
            own, some = slice(ends[q], ends[q + 1]), slice(cuts[q], cuts[q + 1])
            weight[place[own]] = idf[own]
            found.append(self._best(docs[some], upper[some], weight, k))
            weight[place[own]] = 0
        return np.array([len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _rare_sums(self, place: np.ndarray, idf: np.ndarray, query: np.ndarray, queries: int) -> np.ndarray:
        """What the terms that are not frequent add to each document, by query."""
        sums = np.zeros((queries, self.blocks * BLOCK), dtype=np.float32)
        lo, hi, idf = self.bounds[place], self.bounds[place + 1], idf.astype(np.float32)
        ends = np.searchsorted(query, np.arange(queries + 1)).tolist()
        for q, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            own = [slice(*x) for x in zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True)]
            if own:
                impacts = np.concatenate([self.posted[x] for x in own])
                impacts *= np.repeat(idf[a:b], hi[a:b] - lo[a:b])
                sums[q] = np.bincount(np.concatenate([self.doc[x] for x in own]), weights=impacts, minlength=sums.shape[1])
        return sums

    def _reached(self, live: np.ndarray, weights: np.ndarray, sums: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, upper bound of the score) of those that reach their query's `least` in the blocks that are live for it, by query."""
        got = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))]
        for block in np.flatnonzero(live.any(axis=0)).tolist():
            rows = np.flatnonzero(live[:, block])
            impacts = np.zeros(BLOCK * len(self.highest), dtype=np.float32)
            some = slice(self.often_ends[block], self.often_ends[block + 1])
            impacts[self.often[some]] = self.often_part[some]
            upper = weights[rows] @ impacts.reshape(BLOCK, -1).T
            upper += sums[rows, block * BLOCK : (block + 1) * BLOCK]
            upper *= 1 + ROUNDING
            q, doc = np.nonzero((upper >= least[rows, None]) & (upper > 0))
            if len(q):
                got.append((rows[q], doc + block * BLOCK, upper[q, doc]))
        of, docs, upper = map(np.concatenate, zip(*got, strict=True))
        order = np.argsort(of, kind="stable")
        return of[order], docs[order], upper[order]

    def _best(self, docs: np.ndarray, upper: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of one query's documents, whose upper bounds are at most 2 * ROUNDING above their scores."""
        if len(docs) > k and not self.repeated:
            some = upper >= np.partition(upper, len(upper) - k)[len(upper) - k] * (1 - 3 * ROUNDING)
            docs, upper = docs[some], upper[some]
        ids, scores, step = np.zeros(0, dtype=np.int64), np.zeros(0), 8 * max(PROBE, k)
        if len(docs) > step:
            order = np.argsort(-upper, kind="stable")
            docs, upper = docs[order], upper[order]
        while len(docs):
            others, their = self._scored(docs[:step], weight)
            docs, upper = docs[step:], upper[step:]
            ids, scores = np.concatenate([ids, others]), np.concatenate([scores, their])
            best = np.lexsort((ids, -scores))[: 4 * k if not self.repeated else None]
            ids, scores = ids[best], scores[best]
            some = upper >= np.float32(self._threshold(ids, scores, k))
            docs, upper = docs[some], upper[some]
        if self.repeated:
            once = np.sort(np.unique(ids, return_index=True)[1])
            ids, scores = ids[once], scores[once]
        some = scores[:k] > 0
        return ids[:k][some], scores[:k][some]

    def _threshold(self, ids: np.ndarray, scores: np.ndarray, k: int) -> float:
        """The k-th best score of different ids, or 0."""
        if self.repeated:
            order = np.lexsort((-scores, ids))
            scores = scores[order][np.append(True, ids[order][1:] != ids[order][:-1])] if len(ids) else scores
        return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0.0

    def _scored(self, docs: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _ranges(self.ends[docs] - self.sizes[docs], self.ends[docs])
        starts = np.cumsum(self.sizes[docs]) - self.sizes[docs]
        return self.ids[docs], np.add.reduceat(weight[self.number[at]] * self.part[at], starts) if len(docs) else np.zeros(0)


def _alike(numbers: np.ndarray, sizes: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """A group of each document, of those with like frequent terms, so that blocks have much in common.  It sets the order of the documents only."""
    ends = np.cumsum(sizes)

    def directions(lo: int, hi: int) -> np.ndarray:
        own = column[numbers[ends[lo] - sizes[lo] : ends[hi - 1]]]
        some = np.flatnonzero(own >= 0)
        out = np.zeros((hi - lo, width), dtype=np.float32)
        out[np.repeat(np.arange(hi - lo), sizes[lo:hi])[some], own[some]] = 1
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))

    # each centre begins at the document least like those before it, of those of the first ones that have many frequent terms
    learned = directions(0, min(len(sizes), ALIKE))
    kinds = np.count_nonzero(learned, axis=1)
    learned = learned[kinds >= np.median(kinds)]
    centres, nearest = [], learned @ learned.mean(axis=0)
    for _ in range(min(GROUPS, len(learned))):
        centres.append(learned[int(nearest.argmin())])
        nearest = np.maximum(nearest if len(centres) > 1 else -np.inf, learned @ centres[-1])
    centres = np.array(centres)
    for _ in range(4):
        group = np.argmax(learned @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, group, learned)
        centres = sums / np.maximum(np.sqrt((sums**2).sum(axis=1, keepdims=True)), 1e-9)
    return np.concatenate([np.argmax(directions(lo, min(len(sizes), lo + ALIKE)) @ centres.T, axis=1) for lo in range(0, len(sizes), ALIKE)])


def _joined(pieces: list[np.ndarray], out: np.ndarray, of: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """`out`, filled with what `of` makes of each piece; the list is emptied."""
    pieces.reverse()
    at = 0
    while pieces:
        piece = pieces.pop()
        out[at : at + len(piece)] = of(piece)
        at += len(piece)
    return out


def _steps(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, after the last) of runs of documents that have PIECE postings, or one more document's."""
    lo = 0
    while lo < len(ends):
        hi = min(len(ends), int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE)) + 1)
        yield lo, hi
        lo = hi


def _by_term(number: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, ends: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, impacts in 32 bits) of the postings by term, in each term by document; the impacts are for bounds only, as scores come from the forward lists."""
    doc, posted = np.empty(len(number), dtype=np.int32), np.empty(len(number), dtype=np.float32)
    free = bounds[:-1].copy()
    for lo, hi in _steps(ends):
        own = slice(ends[lo] - sizes[lo], ends[hi - 1])
        sort = np.argsort(number[own], kind="stable")
        kinds, first, n = np.unique(number[own][sort], return_index=True, return_counts=True)
        at = np.repeat(free[kinds] - first, n) + np.arange(len(sort))
        doc[at] = np.repeat(np.arange(lo, hi, dtype=np.int32), sizes[lo:hi])[sort]
        posted[at] = part[own][sort]
        free[kinds] += n
    return doc, posted


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers from each lo to before its hi, in a row."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values in a row, sizes) of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat, np.diff(column.offsets.to_numpy())


def _search(rows: DataFrame, k: int, mean: float) -> DataFrame:
    """rows (shard, is_query, id, length, terms, times, idf), of each partition by shard, documents before queries -> (query, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, index = None, [], None
        for batch in batches:
            kinds = batch.column("is_query").to_numpy(zero_copy_only=False)
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if shards[lo] != shard:
                    shard, held, index = shards[lo], [], None
                ids = part.column("id").to_numpy()
                terms, sizes = _lists(part.column("terms"))
                if not kinds[lo]:
                    # copies, so that no batch is kept
                    held.append((ids.copy(), part.column("length").to_numpy().copy(), sizes, terms.view(np.uint64).copy(), _lists(part.column("times"))[0].copy()))
                    continue
                if index is None and held:
                    index = ShardIndex(held, mean)
                if index is None:
                    continue
                idf, ends = _lists(part.column("idf"))[0], np.cumsum(sizes)
                for at in range(0, len(ids), QUERIES):
                    own = sizes[at : at + QUERIES]
                    some = slice(ends[at] - sizes[at], ends[at + len(own) - 1])
                    n, found, scores = index.block_max_wand(terms[some].view(np.uint64), own, idf[some], k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + QUERIES], n)), pa.array(found), pa.array(scores)], names=["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query long, doc_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query, doc_id, score, rank): the k best different documents of each query."""
    once = found.groupBy("query", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def at_once(shards: int, held: int, asked: int, cores: int) -> int:
    """Shards of a round: so many that the terms of the queries, a copy a shard, are at most half as many as all postings, but no fewer than work at once; rounds are of about one size."""
    most = min(shards, max(SHARDS, cores, held // max(1, 2 * asked)))
    return -(-shards // -(-shards // most))


def _by_round(index: DataFrame, together: int) -> DataFrame:
    """`index`, written with a folder for each round's shards."""
    spark = index.sparkSession
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    rounds = index.withColumn("round", F.expr(f"shard div {together}").cast("int"))
    rounds.write.partitionBy("round").parquet(path)
    return spark.read.schema(rounds.schema).parquet(path)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that is run within go when it ends, or those of all rounds would be kept."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def search(docs: DataFrame, is_query: Column, k: int = 10, query_terms: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): for each row where `is_query` holds, the k best rows of all."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    df, n, mean = statistics(named.select("text"))
    asked = written(like_documents(named.where("asks AND doc_id IS NOT NULL").select("doc_id", "text"), df, n, query_terms), "queries")
    pairs = F.sort_array(F.collect_list(F.struct("term", "idf")))  # the words of one text
    sets = asked.groupBy("query_id").agg(pairs.alias("pairs")).select("query_id", F.xxhash64(F.transform("pairs", lambda p: p["term"])).alias("query"), "pairs")
    sets = written(sets, "sets")
    distinct = sets.dropDuplicates(["query"]).select("query", F.transform("pairs", lambda p: p["term"]).alias("terms"), F.transform("pairs", lambda p: p["idf"]).alias("idf"))
    terms = asked.select("term").distinct()
    held = terms.join(df, "term").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    shards = int(max(SHARDS, held // SHARD))
    together = at_once(shards, held, asked.count(), docs.sparkSession.sparkContext.defaultParallelism)
    no_ints, no_doubles = (F.lit(None).cast(f"array<{t}>") for t in ("int", "double"))
    index = postings(named.select("doc_id", "text"), terms, shards).select("shard", F.lit(False).alias("is_query"), F.col("doc_id").alias("id"), "length", "terms", "times", no_doubles.alias("idf"))
    if together < shards:
        index, distinct = _by_round(index, together), written(distinct, "distinct")

    def found(first: int, last: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("shard")
        local = distinct.select(every, F.lit(True).alias("is_query"), F.col("query").alias("id"), F.lit(0).cast("long").alias("length"), "terms", no_ints.alias("times"), "idf")
        own = index.where(F.col("round") == first // together).drop("round") if together < shards else index
        rows = own.unionByName(local).repartitionById(last - first, F.col("shard") - first).sortWithinPartitions("shard", "is_query")
        return _best(_search(rows, k, mean), k)

    if together == shards:
        merged = found(0, shards)
    else:
        with _shuffles_freed(docs.sparkSession):
            parts = [written(found(i, min(shards, i + together)), "found") for i in range(0, shards, together)]
        merged = _best(reduce(DataFrame.unionByName, parts).drop("rank"), k)
    return sets.select("query_id", "query").join(merged, "query").select("query_id", "rank", "doc_id", "score")
