"""The coder of token ids: bounded tables, parts of blocks, groups of blocks; the table of words."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers
import pytest

from tabwarden.llm import range_coder, token_output


def test_tables_of_a_large_file_are_small():
    ids = np.random.default_rng(5).zipf(1.3, 1 << 22) % 50257
    tracemalloc.start()
    blocks = range_coder.encode_blocks(ids)
    assert tracemalloc.get_traced_memory()[1] < 130 << 20
    tracemalloc.reset_peak()
    assert (range_coder.decode_blocks(blocks, len(ids)) == ids).all()
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("n", [1, 7, 513, 4096, 4097, 5 * 4096 + 700])
@pytest.mark.parametrize("kind", ["one", "different", "mixed", "cycle", "late"])
def test_parts_and_groups(monkeypatch, n, kind):
    monkeypatch.setattr(range_coder, "GROUP", 2)
    rng = np.random.default_rng(n)
    ids = {
        "one": np.full(n, 65534),
        "different": rng.permutation(65535)[:n],
        "mixed": rng.zipf(1.2, n) % 65535,
        "cycle": np.arange(n) % 17,  # parts meet the same new ids in one step
        "late": np.where(np.arange(n) % 512 < 400, 3, rng.integers(0, 65535, n)),
    }[kind]
    blocks = range_coder.encode_blocks(ids)
    assert (range_coder.decode_blocks(blocks, n) == ids).all()
    last = len(blocks) - 1
    assert (range_coder.decode_blocks([blocks[last]], n - last * range_coder.BLOCK) == ids[last * range_coder.BLOCK :]).all()


def test_coding_needs_no_table_of_units():
    """Only what is read back looks numbers up by their units."""
    assert not range_coder._Model(3, reads=False).slot.size and range_coder._Model(3, reads=True).slot.size


def test_carries_and_room():
    """Lanes that get more words than there is room for keep what they have."""
    writer, lanes = range_coder._Writer(3), np.arange(3)
    rng = np.random.default_rng(8)
    puts = [(rng.integers(0, 1 << 16, 3).astype(np.uint32), np.ones(3, dtype=np.uint32)) for _ in range(4 * range_coder.STEPS)]
    puts[7:40] = [(np.full(3, 65535, dtype=np.uint32), np.ones(3, dtype=np.uint32))] * 33
    for first, size in puts:
        writer.room(1)
        writer.put(first, size, np.uint64(16))
    order = lanes[::-1]
    writer.order(order)
    reader = range_coder._Reader(writer.end())
    for first, size in puts:
        code, span = reader.shrink(3, np.uint64(16))
        assert (code // span == first[order]).all()
        reader.take(first[order], size)


def test_groups_are_of_like_sizes():
    """A small last group takes almost as many steps as a full one."""
    full = range_coder.GROUP
    for blocks in (1, full, full + 1, 3 * full - 7):
        groups = range_coder._groups(blocks)
        sizes = [hi - lo for lo, hi in groups]
        assert [lo for lo, _ in groups] == [0, *(hi for _, hi in groups[:-1])] and groups[-1][1] == blocks
        assert max(sizes) <= full and max(sizes) - min(sizes) <= 1
    assert range_coder._groups(0) == []


def test_flags_of_parts_are_summed():
    flags = np.random.default_rng(2).random(40 * range_coder.PARTS) < 0.6
    assert (range_coder._upto(flags).reshape(40, -1) == np.cumsum(flags.reshape(40, -1), axis=1)).all()


def test_new_words_go_to_the_model():
    """Without an encoding of each; with every character of plain texts."""
    tokenizer = token_output.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    library = tokenizer.tokenizer
    plain = [c for c in map(chr, range(0x250)) if token_output._PLAIN[ord(c)]]
    texts = ["".join(plain), " ".join(plain), "a".join(plain), "ß it's\n\n  ünd 12ab"]
    tokenizer.tokenizer = None
    ids, sizes = tokenizer.encode(texts)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(x) for x in expected] and ids.tolist() == [k for x in expected for k in x]


def test_words_are_learned_beside_the_large_table(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = token_output.WordTokenizer(path)
    monkeypatch.setattr(token_output, "LATE", 3)
    tokenizer.encode(["some words to begin with, and more"])
    monkeypatch.setattr(token_output, "LATE", 1 << 15)
    known = tokenizer.known
    tokenizer.encode(["entirely different ones"])
    assert len(tokenizer.known[0]) and tokenizer.known is known


@pytest.mark.parametrize(("cache", "late", "near"), [(40, 3, 2), (1000, 17, 1), (1 << 20, 1 << 15, 17)])
def test_words_of_small_tables(monkeypatch, cache, late, near):
    for name, value in (("CACHE", cache), ("LATE", late), ("NEAR", near)):
        monkeypatch.setattr(token_output, name, value)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = token_output.WordTokenizer(path)
    rng = np.random.default_rng(4)
    marks = ["", "<|endoftext|>", "x\x7fy", "ÿ ɏ", "ɐ", "　a", "a\x1cb", "it's  two\n\n blanks ", "naïve space"]
    for _ in range(12):
        texts = ["".join(chr(c) if rng.random() < 0.8 else " " for c in rng.integers(97, 103, n)) for n in rng.integers(0, 60, 20)]
        texts[3:3] = [marks[k] for k in rng.permutation(len(marks))[: rng.integers(0, 9)]]
        ids, sizes = tokenizer.encode(texts)
        expected = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(x) for x in expected] and ids.tolist() == [k for x in expected for k in x]
