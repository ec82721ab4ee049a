"""Language-model scores by prediction by partial matching over bytes.

Spark counts all byte 4-grams of the training texts; they are the deepest nodes of a context trie of
order 3, whose shallower nodes are sums over them.  No node is pruned.  Tasks carry the 4-grams of the
middles (the two bytes before the last) most used, up to MAX_NODES, and all nodes of orders 0 and 1;
grams of other middles are resolved by a join with the table of all 4-grams.  A text is coded with its
end, as the byte 255, which UTF-8 doesn't have, so scores are probabilities of whole texts.  A byte is
predicted in the longest context that the trie holds: a symbol seen n times among T, d of them distinct, has n / (T + d), the escape to the next shorter context d / (T + d) (estimate C),
and symbols of the context escaped from are excluded there.  Below order 0 all bytes left are alike.
Since the trie is static, what exclusion leaves in a suffix is computed once for each context.

The plainer unigram score of words is `unigram`: exact counts of all training tokens; frequent tokens
are looked up in a table of fixed size, all others by a join.

Defined cases.  A null text is empty: it has its end only, as symbol and as token.  A null id is never held
out.  With no training rows every byte has 1/256.  Repeated rows count and score each on their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.llm import bytetext
from tabwarden.llm.tables import written

ORDER = 3
#: 4-grams of the broadcast trie at most: those of the middles most used for their size.
MAX_NODES = 1 << 20
#: Slots of the table of frequent tokens, one token each.
HOT_SLOTS = 1 << 18
END = np.uint64(0x7F4A7C15E4D5A1B3)
_TALLY = 1 << 21
_GRAM, _TOKEN = 0, 1
_MIDDLES = 1 << 16
#: 4-grams of a part that resolves what the broadcast trie lacks, about.
_PART = 1 << 19


class _Tally:
    """Counts of keys, merged now and then; `add` gives them out when there are too many to keep."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.size += len(k)
        if self.size < _TALLY:
            return None
        k, n = self.merged()
        if len(k) > _TALLY // 2:
            self.__init__()
            return k, n
        self.keys, self.counts, self.size = [k], [n], len(k)
        return None

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate(self.counts), minlength=len(keys)).astype(np.int64)


def _ended(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with the byte 255 after each."""
    return np.insert(raw, offsets[1:], 255), offsets + np.arange(len(offsets))


def _grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER + 1 bytes that end at each position, as one number; zeros stand before a text."""
    out = raw.astype(np.uint32)
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    since = np.arange(len(raw), dtype=np.int64)
    since = np.minimum(since - np.repeat(begins, np.diff(np.append(begins, len(raw)))), ORDER).astype(np.uint8) if len(raw) else since
    for k in range(1, ORDER + 1):
        before = np.zeros(len(raw), dtype=np.uint32)
        before[k:] = raw[: len(raw) - k]
        before[since < k] = 0
        out |= before << np.uint32(8 * k)
    return out


def counts(texts: DataFrame) -> DataFrame:
    """(text) -> (kind, key, n): byte 4-grams and tokens of all rows."""

    def batch_of(kind: int, found) -> pa.RecordBatch:
        k, n = found
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, dtype=np.int8)), pa.array(k.astype(np.uint64).view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, tokens, rows = _Tally(), _Tally(), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, raw, offsets in bytetext.chunks(batch.column("text")):
                for kind, tally, keys in ((_GRAM, grams, _grams(*_ended(raw, offsets))), (_TOKEN, tokens, bytetext.words(raw, offsets).hashes)):
                    if (found := tally.add(keys)) is not None:
                        yield batch_of(kind, found)
        yield batch_of(_GRAM, grams.merged())
        yield batch_of(_TOKEN, tokens.merged())
        yield batch_of(_TOKEN, (np.array([END]), np.array([rows])))

    found = texts.mapInArrow(run, "kind byte, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0")


class _Table:
    """A hash table of 32-bit keys with open addressing, all looked up at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length() + 1)
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint32)
        self.index = np.full(1 << bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.index[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.index[at[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), dtype=bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        at = self._slot(keys)
        out = self.index[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            here = self.index[at]
            out[open_] = here
            more = (here >= 0) & (self.keys[at] != keys[open_])
            open_, at = open_[more], at[more]
        return out


class Trie:
    """Static context trie; grams[o]: (keys of o + 1 bytes, counts)."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.log_n, self.log_den, self.log_esc, self.next_den, self.next_esc, self.gram, self.context = [], [], [], [], [], [], []
        orders = []
        for keys, n in grams:
            order = np.argsort(keys)
            keys, n = keys[order].astype(np.uint32), n[order]
            contexts, first = np.unique(keys >> np.uint32(8), return_index=True)
            ends = np.append(first[1:], len(keys))
            orders.append((keys, n, contexts, first, ends, np.add.reduceat(n, first) if len(n) else n, ends - first))
        for o, (keys, n, contexts, first, ends, total, distinct) in enumerate(orders):
            self.gram.append(_Table(keys))
            self.context.append(_Table(contexts))
            self.log_n.append(np.log10(np.maximum(n, 1)))
            self.log_den.append(np.log10(np.maximum(total + distinct, 1)))
            self.log_esc.append(np.log10(np.maximum(distinct, 1)))
            if o:
                below, n_below, c_below, _, _, t_below, d_below = orders[o - 1]
                suffix = np.searchsorted(c_below, contexts & np.uint32((1 << 8 * (o - 1)) - 1))
                same = np.searchsorted(below, keys & np.uint32((1 << 8 * o) - 1))
                seen = np.add.reduceat(n_below[same], first) if len(first) else first
                left = d_below[suffix] - distinct
                den = t_below[suffix] - seen + left
            else:
                left = 256 - distinct
                den = left
            # nothing left: the context below holds only excluded symbols and is passed at no cost
            self.next_den.append(np.log10(np.maximum(den, 1)))
            self.next_esc.append(np.log10(np.maximum(left, 1)))

    def log10_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of the last byte of each gram in the context of the others."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        den = esc = None  # of the escaped-to context; nan: it isn't reached by an escape
        for o in range(len(self.gram) - 1, -1, -1):
            key = grams[left] & np.uint32((1 << 8 * (o + 1)) - 1)
            found = self.gram[o].find(key)
            context = np.full(len(key), 0 if len(self.log_den[0]) else -1) if o == 0 else self.context[o].find(key >> np.uint32(8))
            some = context >= 0
            own_den, own_esc = np.zeros(len(key)), np.zeros(len(key))
            own_den[some], own_esc[some] = self.log_den[o][context[some]], self.log_esc[o][context[some]]
            if den is not None:
                escaped = ~np.isnan(den)
                own_den[escaped], own_esc[escaped] = den[escaped], esc[escaped]
            hit = found >= 0
            out[left[hit]] += self.log_n[o][found[hit]] - own_den[hit]
            miss = ~hit
            out[left[miss]] += own_esc[miss] - own_den[miss]  # 0 where there is no such context
            left, context, some = left[miss], context[miss], some[miss]
            den, esc = np.full(len(left), np.nan), np.full(len(left), np.nan)
            den[some], esc[some] = self.next_den[o][context[some]], self.next_esc[o][context[some]]
        out[left] -= np.where(np.isnan(den), math.log10(256), den)
        return out


def _middle(key: str = "key") -> Column:
    """The two bytes before the last of a gram: all nodes of orders 2 and 3 that its prediction needs share them."""
    return F.expr(f"shiftrightunsigned({key}, 8) & {_MIDDLES - 1}")


def _short(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of order 1: at most 1 << 16."""
    t = grams.groupBy(F.expr("key & 65535").alias("key")).agg(F.sum("n").alias("n")).toArrow()
    return t["key"].to_numpy().astype(np.uint32), t["n"].to_numpy().astype(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(keys & np.uint32(mask), return_inverse=True)
    return k, np.bincount(at, weights=n, minlength=len(k)).astype(np.int64)


def _trie(keys: np.ndarray, n: np.ndarray, short: tuple[np.ndarray, np.ndarray]) -> Trie:
    """Trie of all nodes of orders 0 and 1, and of those of orders 2 and 3 that the given 4-grams make."""
    keys = keys.astype(np.uint32)
    return Trie([_summed(*short, 0xFF), short, _summed(keys, n, 0xFFFFFF), (keys, n)])


def build_trie(grams: DataFrame, max_nodes: int = MAX_NODES) -> tuple[Trie, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """grams (key, n) of ORDER + 1 bytes -> a trie of the 4-grams most used, which middles it lacks, the nodes of order 1."""
    by_middle = grams.groupBy(_middle().alias("middle")).agg(F.count("*").alias("nodes"), F.sum("n").alias("n")).toArrow()  # at most 1 << 16 rows
    middle, nodes, n = (by_middle[c].to_numpy() for c in ("middle", "nodes", "n"))
    order = np.lexsort((middle, -n / np.maximum(nodes, 1)))
    fits = np.cumsum(nodes[order]) <= max_nodes
    lacks = np.zeros(_MIDDLES, dtype=bool)
    lacks[middle[order[~fits]]] = True
    chosen = grams.sparkSession.createDataFrame(pa.table({"middle": pa.array(middle[order[fits]], pa.int64())}))
    hot = grams.withColumn("middle", _middle()).join(F.broadcast(chosen), "middle", "left_semi").select("key", "n").toArrow()
    short = _short(grams)
    return _trie(hot["key"].to_numpy(), hot["n"].to_numpy().astype(np.int64), short), lacks, short


def _resolved(asked: DataFrame, grams: DataFrame, short: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, p): log10 probability of each asked gram (gram), from all 4-grams with its middle.

    A part holds whole middles, of at most 1 << 16 4-grams each; the number of parts follows the number of grams.
    """
    parts = max(1, (grams.count() + asked.count()) // _PART)
    shared = asked.sparkSession.sparkContext.broadcast(short)

    def run(known: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return pa.table({"gram": pa.array([], pa.int64()), "p": pa.array([], pa.float64())})
        trie = _trie(known["key"].to_numpy(), known["n"].to_numpy().astype(np.int64), shared.value)
        return pa.table({"gram": wanted["gram"], "p": pa.array(trie.log10_probabilities(wanted["gram"].to_numpy().astype(np.uint32)))})

    part = lambda c: F.pmod(F.xxhash64(_middle(c)), F.lit(parts)).alias("part")
    left, right = grams.select("key", "n", part("key")), asked.select("gram", part("gram"))
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(lambda a, b: run(a, b), "gram long, p double")


def _lists(of: np.ndarray, n: int, **fields: pa.Array) -> pa.ListArray:
    """Lists of structs for n rows, from values in the order of their rows `of`."""
    ends = np.searchsorted(of, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def _hot(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A table of HOT_SLOTS frequent tokens, one a slot: the most frequent of each."""
    slot = F.expr(f"key & {HOT_SLOTS - 1}")
    rows = tokens.groupBy(slot.alias("slot")).agg(F.max(F.struct("n", "key")).alias("m")).select("slot", "m.n", "m.key").toArrow()
    keys, n = np.zeros(HOT_SLOTS, dtype=np.uint64), np.zeros(HOT_SLOTS, dtype=np.int64)
    at = rows["slot"].to_numpy()
    keys[at], n[at] = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    return keys, n


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", max_nodes: int = MAX_NODES) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) for every row; learned from the rows where `train` holds."""
    text = F.col(text_col).cast("string").alias("text")
    known = written(counts(docs.where(F.coalesce(train, F.lit(False))).select(text)), "counts")
    tokens = known.where(F.col("kind") == _TOKEN).select("key", "n")
    whole = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    grams = known.where(F.col("kind") == _GRAM).select("key", "n")
    trie, lacks, short = build_trie(grams, max_nodes)
    per_token = math.log10(whole["N"] + whole["V"] + 1)
    shared = docs.sparkSession.sparkContext.broadcast((trie, lacks, *_hot(tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, lacks, hot_keys, hot_n = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, last, raw, offsets in bytetext.chunks(batch.column("text")):
                n = last - first
                texts = np.arange(n)
                ended, ends = _ended(raw, offsets)
                of_byte = np.repeat(texts, np.diff(ends))
                grams = _grams(ended, ends)
                cold = lacks[(grams >> np.uint32(8)) & np.uint32(_MIDDLES - 1)]
                p = trie.log10_probabilities(grams[~cold])
                total = np.bincount(of_byte[~cold], weights=p, minlength=n).astype(float)
                pairs, seen = np.unique((of_byte[cold].astype(np.uint64) << np.uint64(32)) | grams[cold], return_counts=True)
                missed = _lists(pairs >> np.uint64(32), n, gram=pa.array((pairs & np.uint64(0xFFFFFFFF)).view(np.int64)), times=pa.array(seen.astype(np.int32)))
                w = bytetext.words(raw, offsets)
                slot = (w.hashes & np.uint64(HOT_SLOTS - 1)).astype(np.int64)
                hot = (hot_keys[slot] == w.hashes) & (hot_n[slot] > 0)
                of_word = np.repeat(texts, np.diff(w.first))
                base = np.bincount(of_word[hot], weights=np.log10(hot_n[slot[hot]] + 1.0), minlength=n).astype(float)
                hot_known = np.bincount(of_word[hot], minlength=n)
                rest = np.flatnonzero(~hot)
                order = rest[np.lexsort((w.hashes[rest], of_word[rest]))]
                key, of = w.hashes[order], of_word[order]
                begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))) if len(order) else order
                times = np.diff(np.append(begins, len(order)))
                rare = _lists(of[begins], n, key=pa.array(key[begins].view(np.int64)), times=pa.array(times.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column("doc_id").slice(first, n), pa.array(np.diff(w.first) + 1), pa.array(hot_known), pa.array(base), pa.array(total), rare, missed],
                    names=["row", "doc_id", "n_tokens", "hot_known", "hot_base", "score", "rare", "missed"],
                )
                row += n

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    scored = written(named.mapInArrow(run, "row long, doc_id long, n_tokens long, hot_known long, hot_base double, score double, rare array<struct<key:long,times:int>>, missed array<struct<gram:long,times:int>>"), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.times").join(tokens, "key")
    sums = rare.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("base"))
    end = tokens.where(F.col("key") == int(END.view(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    out = scored.drop("rare", "missed").join(sums, "row", "left")
    if lacks.any():
        missed = scored.select("row", F.explode("missed").alias("m")).select("row", "m.gram", "m.times")
        asked = written(missed.select("gram").distinct(), "asked")
        middles = docs.sparkSession.createDataFrame(pa.table({"middle": pa.array(np.flatnonzero(lacks), pa.int64())}))  # at most 1 << 16 rows
        lacking = written(grams.withColumn("middle", _middle()).join(F.broadcast(middles), "middle", "left_semi").select("key", "n"), "lacking")
        found = written(_resolved(asked, lacking, short), "resolved")
        late = missed.join(found, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("p")).alias("late"))
        out = out.join(late, "row", "left").withColumn("score", F.col("score") + F.coalesce("late", F.lit(0.0)))
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0)) + F.lit(int(end > 0))).cast("long").alias("n_known"),
        F.lit(whole["N"]).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("base", F.lit(0.0)) + F.lit(math.log10(end + 1)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        "score",
    )
