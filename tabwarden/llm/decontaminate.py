"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Test items are partitioned by their number of shingles into classes of L = 8, 16, 32, ... (an item's
class is the least L that holds it).  A document's shingles, in text order, are cut for every class into
windows of 1.25 L that begin each L / 4; an item that stands in a document lies in one of them, and
takes so large a share of it that one of COORDINATES minima is equal with probability 1 - 1.3e-5 at least
(an item just over half its class, of which 0.8 stand there), however long the document is.  Items of up
to four shingles stand in a document only with all of them and are looked up by one of these, exactly.  Window minima pass a bitmap of fixed size made of all items' minima; what
is left is joined with the items' minima, and each candidate pair is verified: an item is in a document
if the document's shingle set holds `containment` of the item's.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; a shingle has five.

Defined cases.  Null and empty texts, documents or items without words match nothing.  An item of fewer
than five words is one shingle of its whole sequence and is in a document where those words stand in a
row.  Repeated rows each get the same result; items of equal id are one with the shingles of each row
looked for on its own.  A null item id is counted but not listed.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm import bytetext
from tabwarden.llm.tables import written

COORDINATES = 32
SHINGLE_WORDS = 5
LEAST_CLASS = 8
#: Items of so many shingles or fewer are class 1.
FEW = 4
#: Entries of the bitmaps that tasks carry, whatever the number of items.
BITS = 1 << 22

_A = bytetext.mix(np.arange(201, COORDINATES + 201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_X = bytetext.mix(np.arange(301, COORDINATES + 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _slot(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(BITS - 1)).astype(np.int64)


def _short_runs(w: bytetext.Words, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, as `Words.shingles` hashes a text of just these words."""
    n = len(w.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    value, factor = np.full(n, np.uint64(width) * bytetext._SHORT, dtype=np.uint64), np.uint64(1)
    for k in range(width):
        value += w.hashes[k : k + n] * factor
        factor = factor * bytetext._STEP
    return bytetext.mix(value)


def item_signatures(items: DataFrame) -> DataFrame:
    """(item_id, text) -> (item_id, size class, words of a short item or 0, shingles, minima)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, classes, widths, sets, minima = [], [], [], [], []
            for first, last, raw, offsets in bytetext.chunks(batch.column("text")):
                w = bytetext.words(raw, offsets, bytetext.NOT_ALPHANUMERIC)
                hashes, begin = w.shingles(SHINGLE_WORDS)
                for i in range(last - first):
                    distinct = np.unique(hashes[begin[i] : begin[i + 1]])
                    n_words = int(w.first[i + 1] - w.first[i])
                    if not n_words:
                        continue
                    rows.append(first + i)
                    widths.append(n_words if n_words < SHINGLE_WORDS else 0)
                    classes.append(0 if n_words < SHINGLE_WORDS else 1 if len(distinct) <= FEW else max(LEAST_CLASS, 1 << (len(distinct) - 1).bit_length()))
                    sets.append(distinct.view(np.int64))
                    minima.append(np.min((distinct[:, None] ^ _X) * _A, axis=0).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(rows, pa.int64())), pa.array(classes, pa.int64()), pa.array(widths, pa.int32()), pa.array(sets, pa.list_(pa.int64())), pa.array(minima, pa.list_(pa.int64()))],
                names=["item_id", "size_class", "width", "shingles", "minima"],
            )

    return items.mapInArrow(run, "item_id long, size_class long, width int, shingles array<long>, minima array<long>")


def _bitmap(values: DataFrame) -> np.ndarray:
    """values (v long) as a bitmap; at most BITS slots come to the driver."""
    slots = values.select(F.expr(f"v & {BITS - 1}").cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()
    out = np.zeros(BITS, dtype=bool)
    out[slots] = True
    return out


def _window_minima(x: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Minima of windows of 1.25 `size`, each `size` / 4 from the last, as (minima, step)."""
    step = size // 4
    base = x
    width = 1
    while width < step:
        if len(base) % 2:
            base = np.append(base, np.uint64(0xFFFFFFFFFFFFFFFF))
        base = np.minimum(base[0::2], base[1::2])
        width *= 2
    b = np.concatenate([np.full(4, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64), base, np.full(4, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)])
    two = np.minimum(b[:-1], b[1:])
    four = np.minimum(two[:-2], two[2:])
    return np.minimum(four[:-1], b[4:]), step


def document_hits(docs: DataFrame, sizes: list[int], widths: list[int], minima: np.ndarray, shingles: np.ndarray, few: np.ndarray | None) -> DataFrame:
    """(doc_id, text) -> (doc_id, keys array<string> of the window minima that an item may have, shingles that items may have)."""
    shared = docs.sparkSession.sparkContext.broadcast((minima, shingles, few))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_minima, item_shingles, item_few = shared.value
        for batch in batches:
            keys: list[list[str]] = [[] for _ in range(batch.num_rows)]
            kept: list[np.ndarray | None] = [None] * batch.num_rows
            for first, last, raw, offsets in bytetext.chunks(batch.column("text")):
                w = bytetext.words(raw, offsets, bytetext.NOT_ALPHANUMERIC)
                hashes, begin = w.shingles(SHINGLE_WORDS)
                hit: dict[int, set[str]] = {}
                for k in range(COORDINATES if len(hashes) else 0):
                    x = (hashes ^ _X[k]) * _A[k]
                    for size in sizes:
                        low, step = _window_minima(x, size)
                        found = np.flatnonzero(item_minima[_slot(low)])
                        for j in found:
                            lo, hi = max(0, (int(j) - 4) * step), (int(j) + 1) * step
                            text = int(np.searchsorted(begin, lo, side="right")) - 1
                            while text < last - first and begin[text] < hi:
                                if begin[text] < begin[text + 1]:
                                    hit.setdefault(text, set()).add(f"{size}:{k}:{low[j].view(np.int64)}")
                                text += 1
                for j in np.flatnonzero(item_few[_slot(hashes)]) if item_few is not None else ():
                    text = int(np.searchsorted(begin, j, side="right")) - 1
                    hit.setdefault(text, set()).add(f"1:0:{hashes[j].view(np.int64)}")
                for width in widths:
                    runs = _short_runs(w, width)
                    for j in np.flatnonzero(item_shingles[_slot(runs)]):
                        text = int(np.searchsorted(w.first, j, side="right")) - 1
                        if j + width <= w.first[text + 1]:
                            hit.setdefault(text, set()).add(f"0:{width}:{runs[j].view(np.int64)}")
                for text, found in hit.items():
                    own = np.unique(hashes[begin[text] : begin[text + 1]])
                    keys[first + text] = sorted(found)
                    kept[first + text] = own[item_shingles[_slot(own)]].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.list_(pa.string())), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "text_key", "keys", "shingles"])

    return docs.mapInArrow(run, "doc_id long, text_key string, keys array<string>, shingles array<long>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = 0.8) -> DataFrame:
    """(id_col, contaminated, n_items, items array<long> ascending, containment) for every row of `docs`."""
    items = written(item_signatures(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))).distinct(), "items")
    kinds = items.select("size_class", "width").distinct().toArrow().to_pylist()  # a class for each power of two
    if containment < 0.8:
        raise ValueError("windows and minima are made for a containment of 0.8 or more")
    long_items = items.where("size_class > 1")
    minima = _bitmap(long_items.select(F.explode("minima").alias("v")))
    shingles = _bitmap(items.select(F.explode("shingles").alias("v")))
    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_key"))
    sizes, widths = sorted({k["size_class"] for k in kinds} - {0, 1}), sorted({k["width"] for k in kinds} - {0})
    few = _bitmap(items.where("size_class = 1").select(F.col("shingles")[0].alias("v"))) if any(k["size_class"] == 1 for k in kinds) else None
    hits = written(document_hits(named, sizes, widths, minima, shingles, few), "hits")
    found = hits.where("size(keys) > 0").dropDuplicates(["text_key"])
    known = items.withColumn("item", F.xxhash64("item_id", "shingles"))
    short = F.array(F.concat_ws(":", F.lit("0"), F.col("width"), F.col("shingles")[0]))
    long = F.transform("minima", lambda v, k: F.concat_ws(":", F.col("size_class"), k, v))
    one = F.array(F.concat_ws(":", F.lit("1"), F.lit("0"), F.col("shingles")[0]))
    entries = known.select("item", F.explode(F.when(F.col("width") > 0, short).when(F.col("size_class") == 1, one).otherwise(long)).alias("key"))
    pairs = found.select("text_key", F.explode("keys").alias("key")).join(entries, "key").select("text_key", "item").distinct()
    both = pairs.join(found.select("text_key", F.col("shingles").alias("doc_shingles")), "text_key").join(known.select("item", "item_id", "shingles", "width"), "item")
    share = F.when(F.col("width") > 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("shingles", "doc_shingles")) / F.size("shingles"))
    verified = both.withColumn("share", share).where(F.col("share") >= containment)
    by_text = verified.groupBy("text_key").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("items"), F.max("share").alias("containment"))
    # documents without a hit, most of them, need no join
    out = hits.where("size(keys) > 0").select("doc_id", "text_key").join(by_text, "text_key", "left").unionByName(hits.where("size(keys) = 0").select("doc_id", "text_key"), allowMissingColumns=True)
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )
