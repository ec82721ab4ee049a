"""A shard's index is made in little more memory than it keeps."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from pyspark.sql import functions as F

from tabwarden.llm import bm25


def _shard(n: int, rng: np.random.Generator, pieces: int = 7) -> list[tuple[np.ndarray, ...]]:
    docs = [np.unique(rng.zipf(1.2, 300) % 20_000).astype(np.uint64) for _ in range(n)]
    ids, held = rng.permutation(n), []
    for own in np.array_split(np.arange(n), pieces):
        sizes = np.array([len(docs[k]) for k in own])
        held.append((ids[own], sizes * 3, sizes, np.concatenate([docs[k] for k in own]), rng.integers(1, 9, sizes.sum()).astype(np.int32)))
    return held


def test_memory_of_making_it():
    held = _shard(12_000, np.random.default_rng(1), 60)
    postings = sum(len(x[3]) for x in held)
    tracemalloc.start()
    index = bm25.ShardIndex(held, 250.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.part) == postings and not held and peak < 36 * postings


def test_pieces_make_the_same_index(monkeypatch):
    held = _shard(700, np.random.default_rng(2))
    ids, lengths, sizes, terms, times = map(np.concatenate, zip(*held, strict=True))
    whole = bm25.ShardIndex([*held], 250.0)
    monkeypatch.setattr(bm25, "PIECE", 1000)
    pieces = bm25.ShardIndex([*held], 250.0)
    for name, have in vars(whole).items():
        assert np.array_equal(have, getattr(pieces, name)), name
    docs = np.repeat(ids, sizes)
    for k, term in enumerate(whole.terms[:50]):  # postings of each term by document
        assert sorted(pieces.ids[pieces.doc[pieces.bounds[k] : pieces.bounds[k + 1]]]) == sorted(docs[terms == term])
    norm = bm25.K1 * (1 - bm25.B + bm25.B * np.repeat(lengths, sizes) / 250.0)
    assert np.allclose(np.sort(whole.part), np.sort(times * (bm25.K1 + 1) / (times + norm)))


@pytest.mark.parametrize("frequent", [0, 3, 512])
@pytest.mark.parametrize("repeated", [False, True])
def test_batches_find_the_best_and_skip_blocks(monkeypatch, frequent, repeated):
    monkeypatch.setattr(bm25, "BLOCK", 8)
    monkeypatch.setattr(bm25, "PROBE", 3)
    monkeypatch.setattr(bm25, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    # two languages with one term in common; some documents have copies
    docs = [np.unique(np.append(rng.zipf(1.3, 40) % 300 + 1 + 1000 * (k % 2), 0)).astype(np.uint64) for k in range(600)]
    docs[100:130] = [docs[5]] * 30
    ids = np.arange(600) // 2 if repeated else rng.permutation(600)
    sizes, flat = np.array([len(d) for d in docs]), np.concatenate(docs)
    times = rng.integers(1, 9, len(flat)).astype(np.int32)
    index = bm25.ShardIndex([(ids, sizes * 3, sizes, flat, times)], 60.0)
    terms, df = np.unique(flat, return_counts=True)
    idf = np.log(1 + (600 - df + 0.5) / (df + 0.5))
    part = times * (bm25.K1 + 1) / (times + bm25.K1 * (1 - bm25.B + bm25.B * np.repeat(sizes * 3, sizes) / 60.0))
    asked = [*docs[:70], np.array([5000], dtype=np.uint64), docs[599]]
    weights = [idf[np.minimum(np.searchsorted(terms, q), len(terms) - 1)] for q in asked]
    n, found, scores = index.block_max_wand(np.concatenate(asked), np.array([len(q) for q in asked]), np.concatenate(weights), 10)
    ends = np.cumsum(n)
    for q, e, m in zip(asked, ends.tolist(), n.tolist(), strict=True):
        own = np.where(np.isin(flat, q), part * idf[np.searchsorted(terms, flat)], 0)
        best: dict[int, float] = {}
        for i, s in zip(ids.tolist(), np.add.reduceat(own, np.cumsum(sizes) - sizes).tolist(), strict=True):
            best[i] = max(best.get(i, 0.0), s)
        expected = sorted(((-round(s, 9), i) for i, s in best.items() if s > 0))[:10]
        assert [(-round(s, 9), i) for i, s in zip(found[e - m : e].tolist(), scores[e - m : e].tolist(), strict=True)] == expected
    assert index.skipped > (len(asked) * index.blocks // 4 if frequent == 512 else 0)  # the other language's


def test_queries_are_copied_to_no_more_shards_at_once_than_the_postings_allow(spark, monkeypatch):
    """Rounds of shards give what one round does, and none holds more terms of queries than the corpus has postings."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    made = [(i, " ".join(rng.choice(words, 25))) for i in range(400)]
    docs = spark.createDataFrame([*made, *[(i + 1000, t) for i, t in made[:40]]], "doc_id long, text string")
    search = lambda: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in bm25.search(docs, F.col("doc_id") % 4 == 0, k=3).collect())
    once = search()
    held, copied, ran = sum(len(set(t.split())) for _, t in made[:40] + made), [], bm25._search

    def spied(rows, *more):
        copied.append(rows.where("is_query").agg(F.sum(F.size("terms"))).first()[0])
        return ran(rows, *more)

    monkeypatch.setattr(bm25, "SHARDS", 2)
    monkeypatch.setattr(bm25, "SHARD", 600)
    monkeypatch.setattr(bm25, "_search", spied)
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert search() == once and len(once) == 330
    assert max(copied) <= held
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
