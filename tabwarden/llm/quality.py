"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on a text.  The counts of vote patterns
over all texts (at most 3 ** labellers) go to the driver, where expectation-maximisation estimates the
labellers' accuracies and every pattern's posterior, with votes independent given the class.  Posterior
labels of a bounded sample train a linear scorer on hashed features - shapes of short byte runs and the
binned statistics - which then scores every text.

Defined cases.  A text that is null or has no words gets score 0 and is rejected; it doesn't vote.  With
nothing to learn from, texts with words get 0.5 and are kept.  Repeated rows vote and score each on
their own.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm import bytetext

DIMENSIONS = 4096
#: Distinct texts that the linear scorer is trained on: those of the smallest hashes.
SAMPLE = 4000
_CHUNK = 1 << 18

#: (statistic, bad from, good up to): between the two the labeller abstains.
LABELLERS = (
    ("upper_share", 0.5, 0.2),
    ("symbol_share", 0.03, 0.004),
    ("exclaims_per_word", 0.3, 0.05),
    ("bars_per_word", 0.1, 0.01),
    ("repeated_share", 0.2, 0.03),
    ("unlike_words_share", 0.35, 0.1),
    ("open_lines_share", 0.9, 0.3),
    ("long_word_share", 0.3, 0.1),
)

_LOWER = np.zeros(256, dtype=np.int32)
_LOWER[97:123] = 1
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[65:91] = 1
_SYMBOL = np.zeros(256, dtype=np.int32)
_SYMBOL[[ord(c) for c in "#$%&*<>@[]^_`{|}~\\+="]] = 1
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:\"')"]] = True
# shapes: letters by case, digits, blanks and the rest; marks stay themselves
_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 128


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, one column a labeller)."""
    w = bytetext.words(raw, offsets)
    n = np.diff(w.first)
    words, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    upper, lower = _sums(_UPPER[raw], offsets), _sums(_LOWER[raw], offsets)
    again = np.zeros(len(w.hashes), dtype=np.int32)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    again[w.first[:-1][w.first[:-1] < len(again)]] = 0
    letters = _sums((_LOWER + _UPPER)[raw] + (raw >= 128), np.arange(len(raw) + 1))
    running = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(letters, out=running[1:])
    width = w.ends - w.starts
    # a usual word is letters but for one mark at most
    unlike = (width - (running[w.ends] - running[w.starts]) > 1).astype(np.int32)
    newline = raw == 10
    ends = np.zeros(len(raw), dtype=bool)
    if len(raw):
        ends[:-1] = newline[1:]
        ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
        ends &= ~newline
    lines = np.maximum(_sums(ends, offsets), 1)
    return n, np.stack(
        [
            upper / np.maximum(upper + lower, 1),
            _sums(_SYMBOL[raw], offsets) / size,
            _sums(raw == 33, offsets) / words,
            _sums(raw == 124, offsets) / words,
            _sums(again, w.first) / words,
            _sums(unlike, w.first) / words,
            _sums(ends & ~_STOP[raw], offsets) / lines,
            _sums(width > 24, w.first) / words,
        ],
        axis=1,
    )


def votes(values: np.ndarray) -> np.ndarray:
    """1 bad, 2 good, 0 nothing, for each text and labeller."""
    bad, good = (np.array([x[k] for x in LABELLERS]) for k in (1, 2))
    return np.where(values >= bad, 1, np.where(values <= good, 2, 0))


def _features(raw: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    texts = len(offsets) - 1
    half = DIMENSIONS // 2
    x = _SHAPE[raw]
    out = np.zeros((texts, DIMENSIONS), dtype=np.float32)
    if len(raw) > 2:
        text = np.repeat(np.arange(texts, dtype=np.int64), np.diff(offsets))
        run = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        slot = ((run * np.uint32(0x27D4EB2F)) >> np.uint32(21)).astype(np.int64)
        same = text[:-2] == text[2:]
        found = np.bincount((text[:-2] * half + slot)[same], minlength=texts * half).reshape(texts, half)
        out[:, :half] = np.sqrt(found)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    bins = np.minimum((np.sqrt(np.clip(values, 0, 4)) * 16).astype(np.int64), 31)
    at = half + (np.arange(values.shape[1]) * 32 + bins) % half
    np.put_along_axis(out, at, 1.0, axis=1)
    return out


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, raw, offsets in bytetext.chunks(column, _CHUNK):
        for lo in range(0, last - first, 256):
            hi = min(last - first, lo + 256)
            yield first + lo, first + hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def patterns(texts: DataFrame) -> DataFrame:
    """(text) -> (pattern, n): vote patterns in base 3 of all texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 3 ** np.arange(len(LABELLERS))
        counts = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
        for batch in batches:
            for _, _, raw, offsets in _parts(batch.column("text")):
                n, values = statistics(raw, offsets)
                counts += np.bincount((votes(values) @ base)[n > 0], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["pattern", "n"])

    return texts.mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def label_model(found: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of `good` for each pattern, and P(vote | class) as (class, labeller, vote)."""
    k = len(LABELLERS)
    codes = np.array(sorted(found), dtype=np.int64)
    n = np.array([found[c] for c in codes.tolist()], dtype=float)
    vote = (codes[:, None] // 3 ** np.arange(k)) % 3
    # one clear fault outweighs several things in order, to begin with
    good = np.where((vote == 1).any(axis=1), 0.1, 0.9)
    table = np.full((2, k, 3), 1 / 3)
    for _ in range(rounds):
        for y, weight in ((0, n * (1 - good)), (1, n * good)):
            for v in range(3):
                table[y, :, v] = (((vote == v) * weight[:, None]).sum(axis=0) + 0.1) / (weight.sum() + 0.3)
        prior = np.clip((n * good).sum() / max(n.sum(), 1), 0.01, 0.99)
        at = np.arange(k)
        log = [np.log(p) + np.log(table[y, at, vote]).sum(axis=1) for y, p in ((0, 1 - prior), (1, prior))]
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return dict(zip(codes.tolist(), good.tolist(), strict=True)), table


def _training(texts: DataFrame, posterior: dict[int, float]) -> DataFrame:
    """(h, text) -> (h, x binary, y): features and posterior of the texts that have words."""
    shared = texts.sparkSession.sparkContext.broadcast(posterior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            h = batch.column("h").to_numpy()
            for first, last, raw, offsets in _parts(batch.column("text")):
                n, values = statistics(raw, offsets)
                some = np.flatnonzero(n > 0)
                x = _features(raw, offsets, values)[some]
                y = [shared.value.get(int(p), 0.5) for p in (votes(values) @ base)[some]]
                yield pa.RecordBatch.from_arrays([pa.array(h[first:last][some]), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()), pa.array(y, pa.float64())], names=["h", "x", "y"])

    return texts.mapInArrow(run, "h long, x binary, y double")


def _fit(rows: pd.DataFrame, rounds: int = 300) -> np.ndarray:
    rows = rows.sort_values(["h", "x"])
    x, y = np.stack([np.frombuffer(r, dtype=np.float32) for r in rows["x"]]), rows["y"].to_numpy()
    x = np.concatenate([x, np.ones((len(x), 1), dtype=np.float32)], axis=1)
    # both classes weigh alike
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = (y / share + (1 - y) / (1 - share)) / (2 * len(y))
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    w, speed = (np.zeros(x.shape[1], dtype=np.float32) for _ in range(2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = np.float32(0.9) * speed - np.float32(0.8) * ((weight * (p - y)) @ x + np.float32(1e-5) * w)
        w = w + speed
    return w


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """(id_col, n_words, votes, label_posterior, score, kept) for every row.  score: the linear scorer's probability of good."""
    text = F.col(text_col).cast("string").alias("text")
    rows = patterns(docs.select(text)).collect()  # at most 3 ** labellers rows
    found = {r["pattern"]: r["n"] for r in rows}
    posterior, _ = label_model(found) if found else ({}, None)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    weights = None
    if found:
        # of the distinct texts those of the smallest hashes, however often they stand there
        hashed = named.select(F.xxhash64("text").alias("h"), "text").where(F.col("text").rlike(r"[^\x09-\x0D ]"))
        bound = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h").alias("bound"))  # one row
        drawn = hashed.join(F.broadcast(bound), F.col("h") <= F.col("bound")).select("h", "text").distinct()
        # one group of `sample` vectors of a fixed length
        fitted = _training(drawn, posterior).groupBy(F.lit(0).alias("g")).applyInPandas(lambda pdf: pd.DataFrame({"w": [_fit(pdf).tolist()]}), "w array<double>").collect()
        weights = np.array(fitted[0]["w"]) if fitted else None
    shared = docs.sparkSession.sparkContext.broadcast((posterior, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, weights = shared.value
        base = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for first, last, raw, offsets in _parts(batch.column("text")):
                n, values = statistics(raw, offsets)
                vote = votes(values)
                if weights is None:
                    p = np.full(last - first, 0.5)
                else:
                    p = 1 / (1 + np.exp(-np.clip(_features(raw, offsets, values) @ weights[:-1] + weights[-1], -30, 30)))
                p[n == 0] = 0.0
                label = np.array([posterior.get(int(c), 0.5) for c in vote @ base])
                label[n == 0] = 0.0
                said = ["".join("-01"[v] for v in row) for row in vote]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(n), pa.array(said, pa.string()), pa.array(label), pa.array(p), pa.array(p >= threshold)],
                    names=["doc_id", "n_words", "votes", "label_posterior", "score", "kept"],
                )

    return named.mapInArrow(run, "doc_id long, n_words long, votes string, label_posterior double, score double, kept boolean").withColumnRenamed("doc_id", id_col)
