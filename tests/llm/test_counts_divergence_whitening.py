"""Token counts against the library, divergence against plain Python, whitening against an eigenvalue routine."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from tabwarden.llm import divergence, token_counts, whitening
from tabwarden.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MODELS = ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json")


def whole_count(name, text):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return len(SentencePieceProcessor(model_file=path).encode(text))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def odd_texts():
    rng = random.Random(3)
    words = ["a", "the", "é", "naïve", "漢字", "🙂", "<s>", "</s>", "<|endoftext|>", "▁", "x" * 40, "12345", "\n", "\t", "don't", "   "]
    return ["".join(rng.choice(words) + rng.choice((" ", "", "  ", "\n")) for _ in range(3000)), "漢字" * 4000, "ab" * 5000, " " * 9000, "a " * 5000, "▁ " * 3000, "x" * 3000 + " " + "y" * 3000]


@pytest.mark.parametrize("name", MODELS)
@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (500, 40), (1 << 15, 1 << 10)])
def test_spliced_counts_are_those_of_whole_texts(name, chunk, overlap):
    tool = token_counts.codec(public_tokenizers.path(name))
    for text in odd_texts():
        assert token_counts.spliced_count(tool, text, chunk, overlap)[0] == whole_count(name, text)


def test_overlaps_widen_until_a_boundary_is_proven():
    tool = token_counts.codec(public_tokenizers.path("piece_bpe_32k.model"))
    _, tries = token_counts.spliced_count(tool, "a b " * 1000, 400, 20)
    assert tries == 10  # a chunk each
    text = "a b " * 100 + "ab" * 600 + " a b" * 100  # no boundary within 1,200 characters
    count, wide = token_counts.spliced_count(tool, text, 400, 20)
    assert count == whole_count("piece_bpe_32k.model", text) and wide > len(text) // 400 + 1


def test_token_counts_of_rows(spark):
    texts = [(1, ""), (2, None), (None, "null id"), (4, "same"), (4, "same"), (5, "word " * 20000), (6, "漢" * 40000)]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in texts], "doc_id long, text string, n_tokens string, id int")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, public_tokenizers.path(MODELS[0])).collect())
    assert got == sorted((i or 0, len((t or "").encode()), whole_count(MODELS[0], t or "")) for i, t in texts)
    assert token_counts.token_counts(docs.limit(0), public_tokenizers.path(MODELS[0])).count() == 0
    named = docs.selectExpr("cast(doc_id as string) AS key", "text AS body")
    assert token_counts.token_counts(named, public_tokenizers.path(MODELS[0]), "key", "body").columns == ["key", "n_bytes", "n_tokens", "n_chunks"]


def test_op11_counts_each_whole_document(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op11_token_counts"](spark, SF).collect()}
    want = {i: (len((t or "").encode()), whole_count(MODELS[0], t or "")) for i, t in docs.items()}
    assert got == {i: (*w, w[1] > 4096) for i, w in want.items()}


def plain_divergence(rows, least_docs=3, most=200):
    """rows (text, lang, source) -> the audit, by dictionaries."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(lower))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        own = [g for g in groups if g[0] == lang]
        share = lambda c, kept=kept: {t: 1 + 1000000000 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept} if kept else {}
        p = {g: share(counts[g]) for g in own}
        q = share(sum((counts[g] for g in own), Counter()))
        far = lambda a, b: (a - b) * (a - b) // b
        for g in own:
            pair = [(g2[1], sum(far(p[g][t], p[g2][t]) for t in kept)) for g2 in own if g2 != g]
            term = [(t, far(p[g][t], q[t])) for t in kept if counts[g][t] > 0 and p[g][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(*g, part, item, v, i + 1) for i, (item, v) in enumerate(items) if part == "pair" or i < most]
    return sorted(out)


def audit(df, **kw):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.source_divergence(df, **kw).collect())


def test_divergence_of_odd_rows(spark):
    rng = random.Random(5)
    terms = ["a", "Bb", "été", "ÉTÉ", "eightlet", "ninelette", "sixteenlettersxy", "seventeenlettersx", "日本語" * 9, "z" * 3000, "naïveté" * 5, "İ", "ß"]
    rows = [(" 1,".join(rng.choices(terms, k=rng.randrange(0, 40))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", None])) for _ in range(120)]
    rows += [("same same", "en", "s1")] * 5 + [(None, "en", "no terms"), ("", "xx", "alone"), ("12 34", "xx", "two"), ("only twice", "yy", "a"), ("only twice", "yy", "b"), ("hapax", "zz", "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n int, term int")
    assert audit(df) == plain_divergence(rows)
    assert audit(df.repartition(7), least_docs=1, most_terms=3) == plain_divergence(rows, 1, 3)
    assert audit(df.limit(0)) == []


@pytest.mark.parametrize("held", [4, 1 << 19])
def test_divergence_whatever_a_task_holds(spark, monkeypatch, held):
    counts = lambda df: divergence.kept_terms(divergence.term_counts(df)).select("lang", "source", "term", "n", "n_lang").collect()
    df = spark.createDataFrame([("a b c a " * 3, "en", f"s{i % 3}") for i in range(60)], "text string, lang string, source string").coalesce(1)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "COUNT_BYTES", 100)
    got = {(r["source"], r["term"]): (r["n"], r["n_lang"]) for r in counts(df)}
    assert got == {(f"s{i}", t): (n, 3 * n) for i in range(3) for t, n in (("a", 120), ("b", 60), ("c", 60), ("", 0))}


def test_shares_beyond_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**15, 7 * 10**15)], "n long, d long").selectExpr(f"{divergence._share('n', 'd')} AS p").first()
    assert row["p"] == 1 + 10**9 * (3 * 10**15 + 1) // (7 * 10**15)


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(1)
    low, high = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) // np.uint64(1 << 40), rng.integers(0, 3, 2000).astype(np.uint64)
    assert (divergence.radix_order([low, high], 2000) == np.lexsort((np.arange(2000), low, high))).all()


def spectra():
    rng = np.random.default_rng(7)
    yield np.ones(6) * 3
    yield np.repeat([5.0, 1.0], 8)
    yield 10.0 ** -np.arange(20)
    yield np.append(rng.random(40) * 80 + 1, np.zeros(5))
    yield np.array([1.0, 1 + 1e-9, 1 + 2e-9, 2.0])
    yield np.array([4.0])
    yield np.zeros(5)


@pytest.mark.parametrize("values", list(spectra()), ids=lambda v: f"{len(v)}")
def test_components_of_spectra(values):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((len(values),) * 2))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.spectral_components(a)
    scale = np.abs(values).max() or 1.0
    assert np.abs(found - np.sort(np.linalg.eigvalsh(a))[::-1]).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * found) <= 1e-13 * scale * len(a)


def test_polar_factor_is_the_sign():
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((30, 30)))[0]
    values = np.where(np.arange(30) % 3, 1, -1) * 10.0 ** -np.linspace(0, 9, 30)
    a = (q * values) @ q.T
    # an error in `a` moves the sign by as much as the gap at zero is smaller
    assert np.abs(whitening.polar_factor((a + a.T) / 2) - (q * np.sign(values)) @ q.T).max() < 1e-5


def held_against_numpy(vectors, rows, components):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    z = x - sums / n
    cov = z.T @ z / n
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    by = defaultdict(dict)
    for r in rows:
        by[r["vec_id"]][r["component"]] = r
    assert len(rows) == n * min(components, x.shape[1])
    white = np.array([[by[i][c + 1]["whitened"] for c in range(min(components, x.shape[1]))] for i in sorted(by)])
    k = white.shape[1]
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-9
    assert [by[i][1]["deviation"] for i in sorted(by)] == ((n * x - sums) ** 2).sum(axis=1).tolist()
    assert {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1 and 0 <= rows[0]["identity_error"] < 1e-4
    for c in range(k):
        assert by[min(by)][c + 1]["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
        # the projection's direction is an eigenvector: covariance with the data is the eigenvalue times it
        v = z.T @ white[:, c] / n / np.sqrt(values[c])
        assert np.linalg.norm(cov @ v - values[c] * v) < 1e-9 * values[0] and abs(np.linalg.norm(v) - 1) < 1e-9


def test_op13_whitens_the_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    held_against_numpy([r["embedding"] for r in table], QUERIES["op13_embedding_whitening"](spark, SF).collect(), 32)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.standard_normal((50, 3)).tolist()
    good[7] = good[8] = good[9]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [0.0, float("-inf"), 0.0], [1e300, 0.0, 0.0]]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)] + [(1000 + i, v, "y", 2) for i, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, component int")
    held_against_numpy(good, whitening.whiten(table).collect(), 32)
    assert whitening.whiten(table.where("vec_id >= 1000")).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_whitening_without_variance(spark):
    table = spark.createDataFrame([(None, [float(i), 2.0 * i, 5.0]) for i in range(10)], "vec_id long, embedding array<float>")
    rows = whitening.whiten(table).collect()
    assert len(rows) == 30 and {r["component"] for r in rows if r["whitened"] is None} == {2, 3}
    assert all(r["explained"] == pytest.approx(1) for r in rows if r["component"] == 1) and rows[0]["identity_error"] < 1e-9


def test_exact_numbers_beyond_64_bits():
    x = np.array([[2**52, 5], [-(2**52), 7]], dtype=np.int64)
    z = whitening._centred(x, 10**6, [2**60, 3])
    assert [[int(v) for v in r] for r in z] == [[2**52 * 10**6 - 2**60, 5 * 10**6 - 3], [-(2**52) * 10**6 - 2**60, 7 * 10**6 - 3]]
    assert Fraction(int((z * z).sum())) == sum(Fraction(int(v)) ** 2 for v in z.ravel())
