"""Word and shingle hashes of whole texts, taken from Arrow batches with numpy.

Tasks read the UTF-8 bytes of a text column as they lie in the Arrow buffer.  A word is a maximal run
of non-delimiter bytes; delimiters are ASCII, so letters outside ASCII stay inside words.  A word's
hash is a polynomial over its (lower-cased) bytes modulo 2**64, found for all words at once from one
running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one numpy pass takes; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

WHITE_SPACE = np.zeros(256, dtype=bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True

NOT_ALPHANUMERIC = np.zeros(256, dtype=bool)
NOT_ALPHANUMERIC[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SHORT = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        out[0] = 1
        have = _powers[kind] = np.multiply.accumulate(out)
    return have[:n]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them); null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


class Words:
    """The words of some texts: hash, start and end byte of each, and where each text's words begin."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray):
        low = _LOWER[raw]
        n = len(low)
        self.raw, self.low, self.offsets = raw, low, offsets
        if not n:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
            self.hashes = np.zeros(0, dtype=np.uint64)
            self.first = np.zeros(len(offsets), dtype=np.int64)
            return
        inside = ~delimiter[low]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edges] = inside[edges]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        stops = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[stops] = inside[stops]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low] * _power("base", _BASE, n), out=total[1:])
        inverse = _power("inverse", _INVERSE, n)
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])
        self.first = np.searchsorted(self.starts, offsets)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of runs of `size` words in text order, where each text's begin).

        A text with fewer words has its whole sequence as its one shingle; one without words has none.
        """
        h, first = self.hashes, self.first
        counts = np.diff(first)
        per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        begin = np.zeros(len(first), dtype=np.int64)
        np.cumsum(per_text, out=begin[1:])
        if not len(h):
            return np.zeros(0, dtype=np.uint64), begin
        runs = max(0, len(h) - size + 1)
        rolled = np.zeros(runs, dtype=np.uint64)
        factor = np.uint64(1)
        for k in range(size):
            rolled += h[k : k + runs] * factor
            factor = factor * _STEP
        text = np.repeat(np.arange(len(counts)), per_text)
        at = first[text] + (np.arange(len(text)) - begin[text])
        out = np.empty(len(text), dtype=np.uint64)
        long = counts[text] >= size
        out[long] = mix(rolled[at[long]])
        for j in np.flatnonzero(~long):
            value, factor = np.uint64(counts[text[j]]) * _SHORT, np.uint64(1)
            with np.errstate(over="ignore"):
                for x in h[first[text[j]] : first[text[j] + 1]]:
                    value, factor = value + x * factor, factor * _STEP
            out[j] = mix(np.array([value], dtype=np.uint64))[0]
        return out, begin


np.seterr(over="ignore")


def words(raw: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray = WHITE_SPACE) -> Words:
    return Words(raw, offsets, delimiter)


def word_hash(word: str, delimiter: np.ndarray = NOT_ALPHANUMERIC) -> np.uint64:
    """The hash that `words` gives a single word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    found = words(raw, np.array([0, len(raw)], dtype=np.int64), delimiter)
    if len(found.hashes) != 1:
        raise ValueError(f"not one word: {word!r}")
    return found.hashes[0]
