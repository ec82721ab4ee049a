"""Token counts of whole texts, as a public tokenizer's library gives them.

A text of up to a chunk is given to the library whole.  A longer one is encoded in overlapping chunks with
the offsets of their tokens, so that memory is bounded by a chunk and not by the text.  Neighbours are
spliced where both begin a token at the same character of their overlap and where a boundary is proven for
the whole text:

* sentencepiece BPE only ever merges symbols into pieces of its vocabulary, so no merge crosses a place
  whose two neighbouring characters stand beside each other in no piece;
* a byte-level BPE is applied to each word of its pattern alone, and a space after a character that isn't
  white space always begins such a word.

Where an overlap holds no such place, the earlier chunk is encoded again from its last proven boundary with
an overlap twice as wide, up to the whole text.  Vocabularies of other kinds get whole texts.

Defined cases.  A null text is empty and has no tokens (but those that the library gives an empty text).
Ids may be null, repeat or be of any type; each row has its count.  An empty table gives none.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Characters of a chunk and of the overlap of two.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Texts and bytes that the library gets at once, at most, but for a single longer text.
TEXTS, BYTES = 1024, 1 << 20


class PieceCodec:
    """A sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.first = SentencePieceProcessor(model_proto=model.SerializeToString())
        spec, kinds = model.normalizer_spec, model.SentencePiece
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.splits = bool(plain and model.trainer_spec.model_type == model.trainer_spec.BPE and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix)
        merged = (p.piece for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED))
        self.beside = {p[i : i + 2] for p in merged for i in range(len(p) - 1)}
        spec.add_dummy_prefix = False  # later chunks don't begin the text
        self.later = SentencePieceProcessor(model_proto=model.SerializeToString())

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.first.encode(texts, num_threads=1)]

    def begins(self, text: str, first: bool) -> np.ndarray:
        """The character where each token begins, in order."""
        offsets = (self.first if first else self.later).encode_as_offset_mapping(text)["offsets"]
        return np.fromiter((b for b, _ in offsets), dtype=np.int64, count=len(offsets))

    def proven(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", "▁") not in self.beside


class WordCodec:
    """A vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(self.tokenizer.to_str())
        cut = about.get("pre_tokenizer") or {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        loose = any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in added)
        self.splits = about["model"]["type"] == "BPE" and not about.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True) and not loose
        if self.splits:
            self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def begins(self, text: str, first: bool) -> np.ndarray:
        offsets = self.tokenizer.encode(text, add_special_tokens=False).offsets
        return np.fromiter((b for b, _ in offsets), dtype=np.int64, count=len(offsets))

    def proven(self, text: str, at: int) -> bool:
        return text[at] == " " and not text[at - 1].isspace()


@cache
def codec(path: str) -> PieceCodec | WordCodec:
    """One for all tasks of a worker."""
    return PieceCodec(path) if path.endswith(".model") else WordCodec(path)


def spliced_count(tool: PieceCodec | WordCodec, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """(tokens, chunks encoded) of a long text."""
    n = len(text)
    if not tool.splits or n <= chunk:
        return tool.counts([text])[0], 1
    start = total = 0  # the last proven boundary, and the tokens before it
    end, width, encoded = chunk, overlap, 1
    have = tool.begins(text[:end], True)
    while end < n:
        lo, hi = max(start, end - width), min(n, end + chunk)
        new = tool.begins(text[lo:hi], lo == 0) + lo
        common = np.intersect1d(have, new)
        common = common[(common > max(start, lo)) & (common < end)]
        near = common[np.argsort(np.abs(2 * common - lo - end), kind="stable")]  # the middle of the overlap first
        at = next((p for p in near.tolist() if tool.proven(text, p)), None)
        encoded += 1
        if at is None:
            width *= 2
            end = min(n, end + width)
            have = tool.begins(text[start:end], start == 0) + start
            continue
        total += int(np.count_nonzero((have >= start) & (have < at)))
        start, end, have, width = at, hi, new, overlap
    return total + int(np.count_nonzero(have >= start)), encoded


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, n_chunks) of every row; n_chunks: how many encodings its count took."""
    if not 0 < overlap < chunk:
        raise ValueError("an overlap is shorter than a chunk")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    fields = [("n_bytes", LongType()), ("n_tokens", LongType()), ("n_chunks", IntegerType())]
    schema = StructType([StructField("id", rows.schema["id"].dataType), *(StructField(name, kind) for name, kind in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            counts, tries = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int32)
            long = np.flatnonzero(sizes > chunk)  # a text has no more characters than bytes
            for i in long.tolist():
                counts[i], tries[i] = spliced_count(tool, texts[i].as_py(), chunk, overlap)
            rest = np.flatnonzero(sizes <= chunk)
            upto, lo = np.cumsum(sizes[rest]), 0
            while lo < len(rest):
                full = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BYTES, side="right"))
                some = rest[lo : min(max(lo + 1, full), lo + TEXTS)]
                counts[some] = tool.counts(texts.take(pa.array(some)).to_pylist())
                lo += len(some)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(counts), pa.array(tries)], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
