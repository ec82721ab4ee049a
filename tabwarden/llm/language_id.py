"""Language identification by nearest centroid.

A text is a vector of hashed letter n-grams (two and three bytes of the lower-cased UTF-8), weighted by
TF-IDF and scaled to length 1.  Document frequencies come from all labelled texts.  Each language has
several centroids, by spherical k-means over a bounded sample of its labelled texts.  A text gets the
language of the centroid with the highest cosine; it is rejected if that cosine is under the language's
threshold, a low quantile of the sample's own.

Defined cases.  A text that is null or without letters has no language (`und`, score 0).  Rows without a
label don't train.  Without any labelled row every text is `und`.  Equal cosines go to the language that
sorts first.  Repeated rows count as often as they stand there, but once in the sample, and get equal
results.  Over LANGUAGES labels raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.llm import bytetext

DIMENSIONS = 4096
#: Distinct labelled texts of a language that its centroids are fitted on: those of the smallest hashes.
SAMPLE = 400
#: More labels than this aren't languages.
LANGUAGES = 4096
CENTROIDS = 4
UNKNOWN = "und"
_CHUNK = 1 << 18


def _counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of n-gram counts, log-damped: (texts, DIMENSIONS) float32."""
    n, texts = len(raw), len(offsets) - 1
    if n < 2:
        return np.zeros((texts, DIMENSIONS), dtype=np.float32)
    # digits and ASCII marks are blanks: they say nothing about the language
    x = _FOLD[raw].astype(np.uint32)
    text = np.repeat(np.arange(texts, dtype=np.int64), np.diff(offsets))
    two = (x[:-1] * np.uint32(0x9E3779B1)) ^ (x[1:] * np.uint32(0x85EBCA77))
    same = text[:-1] == text[1:]
    key = (text[:-1] * DIMENSIONS + ((two * np.uint32(0xC2B2AE3D)) >> np.uint32(20)).astype(np.int64))[same]
    three = (two[:-1] * np.uint32(0x27D4EB2F)) ^ (x[2:] * np.uint32(0x165667B1))
    same = text[:-2] == text[2:]
    more = (text[:-2] * DIMENSIONS + ((three * np.uint32(0xC2B2AE3D)) >> np.uint32(20)).astype(np.int64))[same]
    found = np.bincount(key, minlength=texts * DIMENSIONS) + np.bincount(more, minlength=texts * DIMENSIONS)
    return np.log1p(found.reshape(texts, DIMENSIONS).astype(np.float32))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x41] = 32
_FOLD[0x5B:0x61] = 32
_FOLD[0x7B:0x80] = 32
_FOLD[0x41:0x5B] += 32


def _vectors(column: pa.Array, idf: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray]]:
    for first, last, raw, offsets in bytetext.chunks(column, _CHUNK):
        for lo in range(0, last - first, 256):
            hi = min(last - first, lo + 256)
            v = _counts(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if idf is not None:
                v *= idf
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield first + lo, first + hi, v


def inverse_document_frequencies(texts: DataFrame) -> np.ndarray:
    """Over all rows of (text); DIMENSIONS + 1 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, v in _vectors(batch.column("text"), None):
                df += (v > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1), pa.int32()), pa.array(np.append(df, n))], names=["slot", "n"])

    rows = texts.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIMENSIONS + 1)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return (np.log((1 + out[-1]) / (1 + out[:-1])) + 0.1).astype(np.float32)


def _spherical_k_means(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = v[np.linspace(0, len(v) - 1, min(k, len(v))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(v @ centres.T, axis=1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = v[near == j].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, quantile: float = 0.005) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """labelled (text, lang) -> (language of each centroid, centroids, idf, rejection threshold of each)."""
    if labelled.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    idf = inverse_document_frequencies(labelled.select("text"))
    # of each label's distinct texts those of the smallest hashes, however often they stand there
    hashed = labelled.select("lang", F.xxhash64("text").alias("h"), "text")
    order = Window.partitionBy("lang").orderBy("h")
    least = hashed.select("lang", "h").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample)
    bounds = least.groupBy("lang").agg(F.max("h").alias("bound"))  # a row a label
    drawn = hashed.join(F.broadcast(bounds), "lang").where("h <= bound").select("lang", "h", "text").distinct()
    shared = labelled.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, v in _vectors(batch.column("text"), shared.value):
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), batch.column("h").slice(lo, hi - lo), pa.array([x.tobytes() for x in v], pa.binary())], names=["lang", "h", "v"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["h", "v"])
        v = np.stack([np.frombuffer(x, dtype=np.float32) for x in rows["v"]])
        centres = _spherical_k_means(v, centroids)
        threshold = float(np.quantile((v @ centres.T).max(axis=1), quantile))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(centres)), "centre": [c.tolist() for c in centres], "threshold": threshold})

    vectored = drawn.mapInArrow(vectors, "lang string, h long, v binary")
    found = vectored.groupBy("lang").applyInPandas(one, "lang string, k int, centre array<float>, threshold double").toPandas().sort_values(["lang", "k"])
    centres = np.array(found["centre"].tolist(), dtype=np.float32).reshape(-1, DIMENSIONS)
    return found["lang"].tolist(), centres, idf, found["threshold"].to_numpy()


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(id_col, lang_nearest, rejected, score) for every row; rows where `train` holds and the label is not null are learned from.

    rejected: the cosine is under the nearest language's threshold; a caller may take those for unknown.
    """
    text = F.lower(F.col(text_col).cast("string"))
    labelled = docs.where(F.coalesce(train, F.lit(False)) & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    langs, centres, idf, thresholds = fit(labelled.select(text.alias("text"), F.col(lang_col).cast("string").alias("lang")), **options)
    shared = docs.sparkSession.sparkContext.broadcast((langs, centres, idf, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, centres, idf, thresholds = shared.value
        for batch in batches:
            n = batch.num_rows
            near, score = np.full(n, -1), np.zeros(n)
            if langs:
                for lo, hi, v in _vectors(batch.column("text"), idf):
                    cosine = v @ centres.T
                    near[lo:hi] = np.argmax(cosine, axis=1)
                    score[lo:hi] = np.clip(cosine.max(axis=1), 0, 1)
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            near[~letters], score[~letters] = -1, 0.0
            named = [langs[k] if k >= 0 else UNKNOWN for k in near]
            rejected = [k < 0 or s < thresholds[k] for k, s in zip(near, score, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, pa.string()), pa.array(rejected, pa.bool_()), pa.array(score)], names=["doc_id", "lang_nearest", "rejected", "score"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return named.mapInArrow(run, "doc_id long, lang_nearest string, rejected boolean, score double").withColumnRenamed("doc_id", id_col)
