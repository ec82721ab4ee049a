"""Token ids of documents in checksummed binary files.

Documents are dealt by ranges of their id; each task tokenizes its range in order and packs it into files
of about FILE_IDS ids (`range_coder` has the format), written as rows of a table of blobs in the shared
folder, so that the output commits with Spark's own protocol and survives lost executors.  Reading
decodes the files, checks every block's checksum and adds the files' sizes up to global positions.

A byte-level tokenizer is applied word by word: texts are cut where its own pattern cuts them, found from
the classes of their characters with numpy, and a word met before, known by a 64-bit hash, is looked up.
A new word is given to the library's model, with its bytes named as the library's own cutting names them.
Texts with characters for which the cut might differ or with the name of a special token, and all texts
where the tokenizer isn't of that kind, are given to it whole.

Defined cases.  A null text is empty: its document has the end id only.  Null ids come first.  Equal ids
are ordered by text.  An empty table gives an empty table of files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.llm import bytetext, range_coder
from tabwarden.llm.tables import written

FILE_IDS = 4 << 20
#: Texts and bytes that are cut into words at once, at most, but for a single longer text.
TEXTS, BYTES = 256, 1 << 19
#: Words whose ids a worker keeps, about; 30 bytes each.
CACHE = 2_000_000
#: Words that are learned before they join the others.
LATE = 1 << 15
#: Bits of a word's hash by which it is looked up first.
NEAR = 17
#: Stands between new words; its bytes are in no plain text.
BETWEEN = "\uffff"

# Fixed value: the pattern by which the byte-level vocabulary cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# outside these characters, libraries may differ on what a letter or a blank is
_PLAIN = np.zeros(0x251, dtype=bool)  # the last one stands for all beyond
_PLAIN[[*range(0x1C), *range(0x20, 0x7F), *range(0xA1, 0x250)]] = True
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)
_CLASS = np.array([_BLANK if regex.match(r"\s", c) else _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _OTHER for c in map(chr, range(0x250))], dtype=np.uint8)
_CODE = bytetext.mix(np.arange(1, 0x251, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of PATTERN begin in the characters of some plain texts; first: where each text begins."""
    n = len(codes)
    kind = _CLASS[codes]
    edge = np.zeros(n + 1, dtype=bool)
    edge[first] = edge[n] = True  # an empty text begins where the next does
    run = edge[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == _BLANK
    start = run.copy()
    # the last blank before a word is cut off from those before it, and a space goes with the word
    inner = run & ~blank & ~edge[:n]
    after = np.flatnonzero(inner)
    after = after[blank[after - 1]]
    start[after - 1] = True
    start[after[codes[after - 1] == 32]] = False
    # an apostrophe alone between a word and a known ending goes with the ending
    mark = np.flatnonzero((codes == 39) & start & run)
    padded = np.append(codes, [0, 0, 0])
    stop = np.append(edge, [True, True, True])
    letter = np.append(kind == _LETTER, [False, False, False])
    mark = mark[letter[mark + 1] & ~stop[mark + 1]]
    one, two = padded[mark + 1], padded[mark + 2]
    short = np.isin(one, [115, 116, 109, 100])  # s t m d
    long = ~stop[mark + 2] & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))  # re ve ll
    width = np.where(short, 1, np.where(long, 2, 0))
    mark, width = mark[width > 0], width[width > 0]
    start[mark + 1] = False
    rest = mark + 1 + width
    rest = rest[letter[rest] & ~stop[rest]]
    start[rest] = True
    return np.flatnonzero(start)


def _codes(texts: list[str]) -> np.ndarray:
    """The characters of all texts in a row."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _with_room(x: np.ndarray, n: int) -> np.ndarray:
    """`x`, made longer by a quarter or more where it has less than n entries."""
    return x if len(x) >= n else np.append(x, np.zeros(max(n - len(x), len(x) // 4), dtype=x.dtype))


def _merged(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`table` with other sorted hashes and their rows."""
    at = np.searchsorted(table[0], hashes)
    return np.insert(table[0], at, hashes), np.insert(table[1], at, rows)


class WordTokenizer:
    """ids of whole texts by the tokenizers library, with a bounded table of words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > range_coder.NONE:
            raise ValueError(f"files hold ids under {range_coder.NONE}")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        about = json.loads(self.tokenizer.to_str())
        cut = about.get("pre_tokenizer") or {}
        self.by_words = about["model"]["type"] == "BPE" and not about.get("truncation") and not about.get("padding") and not about.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
        self.model = self.tokenizer.model
        # the character by which the library names each byte
        self.named = np.zeros(256, dtype="<u4")
        for c in [*map(chr, range(0x250)), BETWEEN]:
            self.named[list(c.encode())] = [ord(x) for x in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]]
        self._empty()

    def _empty(self) -> None:
        # (sorted hashes, row of each): words learned lately are apart, so that the large table is seldom made anew
        self.known, self.late = ((np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)) for _ in range(2))
        # of the rows so far: where each begins in the ids, with the end after the last; both have room for more
        self.rows, self.start = 0, np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint16)
        # a word of each value of its hash's first bits, to be looked at before the others
        self.near, self.near_row = np.zeros(1 << NEAR, dtype=np.uint64), np.full(1 << NEAR, -1, dtype=np.int64)

    def _word_ids(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, which is cut already; an encoding of each would take most of the time."""
        named = [self.named[np.frombuffer(x.encode(), dtype=np.uint8)].tobytes().decode("utf-32-le") for x in (BETWEEN.join(words), BETWEEN)]
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(w)] for w in named[0].split(named[1])]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = self._word_ids(words)
        ends = self.start[self.rows] + np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        first, rows = int(self.start[self.rows]), self.rows + len(ids)
        self.start, self.flat = _with_room(self.start, rows + 1), _with_room(self.flat, int(ends[-1]))
        self.start[self.rows + 1 : rows + 1] = ends
        self.flat[first : ends[-1]] = np.fromiter(chain.from_iterable(ids), dtype=np.uint16, count=int(ends[-1]) - first)
        self.late = _merged(self.late, hashes, np.arange(self.rows, rows))
        self.rows = rows
        if len(self.late[0]) > LATE:
            self.known, self.late = _merged(self.known, *self.late), tuple(x[:0] for x in self.late)

    def _lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each known hash, whether it is known)."""
        row, have = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        for known, rows in (self.known, self.late):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                here = known[at] == hashes
                row[here] = rows[at[here]]
                have |= here
        return row, have

    def _rows(self, hashes: np.ndarray, word: Callable[[int], str]) -> np.ndarray:
        """The row of each word in the table; word: its characters, by its place."""
        if self.rows > CACHE:
            self._empty()
        slot = (hashes >> np.uint64(64 - NEAR)).astype(np.int64)
        row = self.near_row[slot]
        far = np.flatnonzero((self.near[slot] != hashes) | (row < 0))
        if len(far):
            kinds, sample, at = np.unique(hashes[far], return_index=True, return_inverse=True)
            own, have = self._lookup(kinds)
            new = np.flatnonzero(~have)
            if len(new):
                self._learn(kinds[new], [word(k) for k in far[sample[new]].tolist()])
                own, _ = self._lookup(kinds)
            row[far] = own[at]
            to = slot[far[sample]]
            self.near_row[to] = own
            self.near[to] = kinds
        return row

    def _plain(self, texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(codes):
            return np.zeros(0, dtype=np.uint16), np.zeros(len(texts), dtype=np.int64)
        joined = "".join(texts)
        lengths = np.array([len(t) for t in texts])
        first = np.cumsum(lengths) - lengths
        begin = word_starts(codes, first)
        end = np.append(begin[1:], len(codes))
        power = bytetext._power("base", _ODD, len(codes))
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_CODE[codes] * power, out=total[1:])
        hashes = bytetext.mix((total[end] - total[begin]) * bytetext._power("inverse", _INVERSE, len(codes))[begin] + (end - begin).astype(np.uint64))
        row = self._rows(hashes, lambda k: joined[begin[k] : end[k]])
        size = self.start[row + 1] - self.start[row]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[row] - (ends - size), size) + np.arange(ends[-1])]
        of_words = np.append(0, ends)[np.searchsorted(begin, np.append(first, len(codes)))]
        return ids, np.diff(of_words)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        codes = _codes(texts)
        plain = np.full(len(texts), self.by_words)
        ends = np.cumsum([len(t) for t in texts])
        plain[np.searchsorted(ends, np.flatnonzero(~_PLAIN[np.minimum(codes, 0x250)]), side="right")] = False
        if any(s in t for s in self.special for t in texts):
            plain &= [not any(s in t for s in self.special) for t in texts]
        if not plain.all():
            codes = _codes([t for t, p in zip(texts, plain, strict=True) if p])
        ids, counts = self._plain([t for t, p in zip(texts, plain, strict=True) if p], codes)
        if plain.all():
            return ids, counts
        own = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else ())
        parts = [next(own) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint16) for t, p in zip(texts, plain, strict=True)]
        return np.concatenate(parts), np.array([len(x) for x in parts])


@cache
def _tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a worker."""
    return WordTokenizer(path)


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, after the last) text of each run that is cut at once."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        full = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BYTES, side="right"))
        hi = min(max(lo + 1, full), lo + TEXTS)
        yield lo, hi
        lo = hi


def write_files(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, file, n_docs, n_ids, payload): files in ascending order of ids, written to the shared folder."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # rows without an id, or of one id, are dealt out by how their texts begin, which is in the order of the texts
    ordered = named.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.left("text", F.lit(64))).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        if not 0 <= end_id < range_coder.NONE:
            raise ValueError(f"files hold ids under {range_coder.NONE}")
        part, file = TaskContext.get().partitionId(), 0
        docs_in: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def out() -> pa.RecordBatch:
            doc_ids, null, sizes, ids = (np.concatenate(x) for x in zip(*docs_in, strict=True))
            blob = range_coder.encode_file(doc_ids, null, sizes, ids)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([file]), pa.array([len(doc_ids)]), pa.array([len(ids)]), pa.array([blob], pa.binary())], names=["part", "file", "n_docs", "n_ids", "payload"])

        for batch in batches:
            doc_ids, null = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            texts = batch.column("text")
            for lo, hi in _runs(texts):
                some = texts.slice(lo, hi - lo).to_pylist()
                ids, sizes = tokenizer.encode(some)
                ends = np.cumsum(sizes)
                whole = np.insert(ids, ends, end_id)
                docs_in.append((doc_ids[lo:hi], null[lo:hi], sizes + 1, whole))
                held += len(whole)
                if held >= FILE_IDS:
                    yield out()
                    docs_in.clear()
                    held, file = 0, file + 1
        if docs_in:
            yield out()

    return written(ordered.mapInArrow(run, "part long, file long, n_docs long, n_ids long, payload binary"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, null, sizes, ids = range_coder.decode_file(batch.column("payload")[row].as_py())
                ends = np.cumsum(sizes)
                crc = [range_coder.checksum(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                first = batch.column("before")[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=null), pa.array(ends - sizes + first), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a file, without its payload
    order = Window.partitionBy().orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("part", "file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    return files.select("part", "file", "payload").join(F.broadcast(before) if files.count() < 100_000 else before, ["part", "file"]).select("payload", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and read them back."""
    return read_files(write_files(docs, vocabulary, end_id, id_col, text_col)).withColumnRenamed("doc_id", id_col)
