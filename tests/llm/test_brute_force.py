"""Operators against plain Python versions, on the smallest tables and on odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwarden.llm import bm25, bytetext, decontaminate, language_id, license_scan, mixing, near_dup, ppm, quality, range_coder, secrets, token_output
from tabwarden.llm.tables import held_out

SF = "/root/testdata/sf0.001"
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n ", "en", "a"), (4, "one", "en", None), (4, "one", "en", None), (5, "x" * 70000, None, "b"), (None, "all rights reserved", "fr", "b"), (6, "The quick brown fox " * 50, "de", "b"), (7, "The quick brown fox " * 50, "de", "b")]
SHAPE = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE).withColumn("component", F.lit(1)).withColumn("rep", F.lit(2))


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", lower(t))


def plain(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def test_word_hashes(rows):
    import pyarrow as pa

    texts = [t for _, t, _ in rows]
    for first, last, raw, offsets in bytetext.chunks(pa.array(texts)):
        w = bytetext.words(raw, offsets)
        for i in range(last - first):
            expected = words(texts[first + i])
            own = w.hashes[w.first[i] : w.first[i + 1]]
            assert len(own) == len(expected) and len(set(own.tolist())) == len(set(expected))


def linked_sets(rows):
    """Sets of 2-word shingles and components, by comparing all pairs."""
    sets = {}
    for i, t, _ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            n = len(x & y)
            if n and 100 * n >= 80 * (len(x) + len(y) - n):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sets, {i: find(i) for i in ids}


def test_near_duplicates(docs, rows):
    sets, root = linked_sets(rows)
    for r in near_dup.near_duplicates(docs, shingle_words=2).collect():
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (root[r["doc_id"]], len(sets[r["doc_id"]]), root[r["doc_id"]] == r["doc_id"])


def test_family_in_many_blocks(spark, monkeypatch):
    """Copies of one text that drift apart: alike to 0.6-0.9, few linked, in blocks of some members each."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    made = [(i, " ".join(w if rng.random() > 0.06 else f"x{rng.integers(40)}" for w in base), "") for i in range(150)]
    sets, root = linked_sets(made)
    assert 20 < len(set(root.values())) < 149
    monkeypatch.setattr(near_dup, "BLOCK", 1500)
    d = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(d, shingle_words=2).collect()} == root


def test_contamination(spark, docs, rows):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    sh = lambda t: {tuple(plain(t)[k : k + 5]) for k in range(max(1, len(plain(t)) - 4))} if plain(t) else set()
    known = {r["item_id"]: sh(r["text"]) for r in items.collect()}
    got = {r["doc_id"]: r["items"] for r in decontaminate.contamination(docs, items).collect()}
    for i, t, _ in rows:
        own = sh(t)
        assert got[i] == sorted(k for k, s in known.items() if s and len(s & own) >= 0.8 * len(s))


def test_short_items(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "b a"), (3, "x b, C y")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "b c"), (8, None), (7, "")], "item_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontaminate.contamination(d, items).collect()} == {1: [9], 2: [], 3: [9]}


def test_ppm_and_unigram(docs, rows):
    train = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in [*words(t), "\0"])
    n, v = sum(counts.values()), len(counts)
    trie = [defaultdict(Counter) for _ in range(4)]
    for t in train:
        b = b"\0\0\0" + t.encode() + b"\xff"
        for p in range(3, len(b)):
            for o in range(4):
                trie[o][b[p - o : p]][b[p]] += 1

    def code_length(t):
        b, s = b"\0\0\0" + t.encode() + b"\xff", 0.0
        for p in range(3, len(b)):
            out = set()
            for o in (3, 2, 1, 0):
                left = {k: m for k, m in trie[o].get(b[p - o : p], {}).items() if k not in out}
                if not left:
                    continue
                total = sum(left.values()) + len(left)
                if b[p] in left:
                    s += math.log10(left[b[p]] / total)
                    break
                s += math.log10(len(left) / total)
                out |= set(left)
            else:
                s -= math.log10(256 - len(out))
        return s

    got = {r["doc_id"]: r for r in ppm.score(docs, ~held_out("doc_id", 7)).collect()}
    for i, t, _ in rows:
        w = [*words(t), "\0"]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        if i % 5 == 0:
            assert r["score"] == pytest.approx(code_length(t), rel=1e-9)


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    due, taken = {}, Counter()
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == size[source[r["doc_id"]]]
        due[source[r["doc_id"]]] = r["target"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(got) == len(rows) and sum(due.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - due[s]) <= 1 and due[s] <= 3 * size[s] + 1e-6 for s in due)


def test_secrets(docs, rows):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    for i, t, _ in rows:
        e = [(m.start(), m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        e += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        e += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(e) == sorted((s["start"], s["end"], s["kind"]) for s in got[i] if s["kind"] in secrets.BASE_KINDS)


def test_weak_parts_need_their_complement(spark):
    blob = "Zx9" * 12
    d = spark.createDataFrame([(1, f"é client_id=acme-prod then {blob} at https://db.example.com/x"), (2, f"only {blob} here"), (3, "client_id=acme-prod alone")], "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(d).collect()}
    assert got == {1: ["identifier", "blob", "endpoint"], 2: [], 3: []}


def test_licenses(docs, rows):
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, t, _ in rows:
        w = plain(t)
        at = [k for p in license_scan.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_languages(docs):
    found = language_id.identify(docs, ~held_out("doc_id", 4)).join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id", 4)).toPandas()
    assert (found["lang"] == found["lang_nearest"]).mean() > 0.95


def test_quality(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = quality.classify(d).join(labels, "doc_id").toPandas()
    assert (m["kept"] == (m["quality"] == 1)).mean() > 0.95 and m[m["quality"] == 1]["kept"].mean() > 0.97


def best(rows, ask, k=10):
    """{query: [(doc_id, score)]} by scoring every row with all words that another row has too."""
    bags = [(i, Counter(plain(t or ""))) for i, t in rows]
    n, df = len(bags), Counter(w for _, c in bags for w in c)
    mean = sum(sum(c.values()) for _, c in bags) / n
    idf = {w: math.log(1 + (n - m + 0.5) / (m + 0.5)) for w, m in df.items()}
    out = {}
    for q, c in bags:
        if q is not None and ask(q):
            terms = set(out.get(q, ((), ()))[1]) | {w for w in c if df[w] > 1}
            found = {}
            for i, e in bags:
                s = sum(idf[w] * e[w] * 2.2 / (e[w] + 1.2 * (0.25 + 0.75 * sum(e.values()) / mean)) for w in sorted(terms & set(e)))
                if i is not None and s > 0:
                    found[i] = max(s, found.get(i, 0))
            out[q] = (sorted(found.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k], terms)
    return {q: x[0] for q, x in out.items() if x[0]}


def searched(found):
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def assert_same_hits(got, expected):
    assert set(got) == set(expected)
    for q, hits in expected.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in hits])
        assert [(round(s, 9), i) for i, s in got[q]] == [(round(s, 9), i) for i, s in hits]


def test_search(docs, rows):
    assert_same_hits(searched(bm25.search(docs, F.col("doc_id") % 20 == 0)), best([(i, t) for i, t, _ in rows], lambda q: q % 20 == 0))


def test_search_ties_and_odd_rows(spark, monkeypatch):
    """Copies tie to the smaller id; equal ids are found once; blocks, probes and shards of few documents."""
    monkeypatch.setattr(bm25, "PROBE", 2)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    rng = np.random.default_rng(9)
    words_ = [f"w{k}" for k in range(40)]
    made = [(i, " ".join(rng.choice(words_, rng.integers(1, 30), p=(p := 1 / np.arange(1, 41)) / p.sum()))) for i in range(300)]
    made += [(i + 1000, t) for i, t in made[:60]] + [(5, "w1 w2 w39"), (5, "w39 w38"), (None, "w1"), (7, None), (2000, ""), (2020, "...")]
    d = spark.createDataFrame(made, "doc_id long, text string")
    assert_same_hits(searched(bm25.search(d, F.col("doc_id") % 20 == 0, k=3)), best(made, lambda q: q % 20 == 0, 3))


def test_range_coder():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4095, 4096, 4097, 9000):
        ids = rng.zipf(1.3, n) % 50257
        blob = range_coder.encode_file(np.array([1, 2]), np.array([0, 1]), np.array([n // 2, n - n // 2]), ids)
        assert (range_coder.decode_file(blob)[3] == ids).all()
    damaged = bytearray(blob)
    damaged[-9] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode_file(bytes(damaged))


def test_token_files(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, start = Tokenizer.from_file(path), 0
    got = token_output.token_output(docs, path, 2).orderBy("doc_id").collect()
    for r, (i, text, _) in zip(got, sorted(rows), strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_words_and_whole_texts_tokenize_alike():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["", "<|endoftext|> a", "\x1c x y  \n\n z 漢字 \x85 q\xa0\xa0r", "don't we'll 123 ٣٤ ", "é" * 30]
    ids, sizes = token_output.WordTokenizer(path).encode(texts)
    expected = [t.encode(s, add_special_tokens=False).ids for s in texts]
    assert ids.tolist() == sum(expected, []) and sizes.tolist() == [len(e) for e in expected]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, odd, empty):
    import public_tokenizers

    d = odd.where("false") if empty else odd
    n = 0 if empty else len(ODD)
    items = spark.createDataFrame([(1, None)], "item_id long, text string")
    train = ~held_out("doc_id", 4)
    for f in (
        lambda: language_id.identify(d, train),
        lambda: license_scan.scan(d),
        lambda: decontaminate.contamination(d, items),
        lambda: ppm.score(d, train),
        lambda: mixing.mix(d),
        lambda: quality.classify(d),
        lambda: secrets.scan(d),
        lambda: near_dup.near_duplicates(d),
        lambda: token_output.token_output(d, public_tokenizers.path("byte_bpe_50k.json"), 2),
    ):
        assert f().count() == n
    expected = {} if empty else best([(r[0], r[1]) for r in ODD], lambda q: q % 2 == 0)
    assert_same_hits(searched(bm25.search(d, F.col("doc_id") % 2 == 0)), expected)
    if not empty:
        parts = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(d).collect()}
        assert parts[7] == 6 and parts[1] == 1


def test_items_of_few_shingles(spark):
    """One shingle in a long text, at any place; four shingles count only with all of them."""
    filler = [f"w{k}" for k in range(300)]
    texts = [" ".join([*filler[:k], "a b c d e", *filler[k:]]) for k in range(0, 300, 7)]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(900, "s t u v w x y z"), (901, "s t u v w x y q"), (902, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b c, d e"), (2, "s t u v w x y z")], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.contamination(d, items).collect()}
    assert got == {**{k: [1] for k in range(len(texts))}, 900: [2], 901: [], 902: []}
    with pytest.raises(ValueError):
        decontaminate.contamination(d, items, containment=0.7)


@pytest.mark.parametrize("unit", ["a.", "x", "<", "password:", "-", "AKIA", "0f", "http://", "a-.", " "])
def test_secrets_of_long_texts(spark, unit):
    d = spark.createDataFrame([(1, unit * (1_000_000 // len(unit)))], "doc_id long, text string")
    assert secrets.digest(secrets.scan(d)).count() == 1


def test_endpoints(spark):
    d = spark.createDataFrame([(1, "user_id=acme-prod AbCdEfGhIjKlMnOpQrStUvWxYz0123456789 db.example.com:5432 or x.example.company")], "doc_id long, text string")
    text = d.first()["text"]
    got = [text[s["start"] : s["end"]] for s in secrets.scan(d).first()["spans"] if s["kind"] == "endpoint"]
    assert got == ["db.example.com:5432"]


def test_near_duplicates_of_null_and_equal_ids(spark):
    a, b = "the quick brown fox jumps over a lazy dog and runs far away today", "some other words that are not at all like those of the first text here"
    rows = [(None, a), (6, a + " x"), (5, a + " y"), (None, b), (None, b), (3, "alone in the world of texts"), (3, a), (None, None), (9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(d, shingle_words=2).collect()), key=str)
    n = len(a.split()) - 1
    expected = [(None, n, 3, False), (6, n + 1, 3, False), (5, n + 1, 3, False), (None, len(b.split()) - 1, None, True), (None, len(b.split()) - 1, None, True), (3, 5, 3, True), (3, n, 3, True), (None, 0, None, True), (9, 0, 9, True)]
    assert got == sorted(expected, key=str)


def test_near_duplicates_of_two_groups_and_chains(spark):
    """Two groups of drifting copies that share a passage, so that their members stand in each other's rings."""
    rng = np.random.default_rng(11)
    passage = [f"p{k}" for k in range(60)]
    made = []
    for g in range(3):
        base = [*passage, *(f"g{g}w{k}" for k in range(60))]
        for i in range(50):
            base = [w if rng.random() > 0.055 else f"x{rng.integers(60)}" for w in base]
            made.append((g * 1000 + i, " ".join(base), ""))
    sets, root = linked_sets(made)
    assert len(set(root.values())) > 3
    d = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(d, shingle_words=2).collect()} == root


def test_blocks_decode_alone():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.zipf(1.2, 9000) % 65535, np.tile(rng.integers(0, 65535, 7), 300), [0, 65534] * 20])
    blob = range_coder.encode_file(np.array([1]), np.array([0]), np.array([len(ids)]), ids)
    blocks = -(-len(ids) // range_coder.BLOCK)
    got = [range_coder.decode_block(blob, k) for k in range(blocks)]
    assert (np.concatenate(got) == ids).all()
    # the bytes of other blocks don't matter
    torn = bytearray(blob)
    torn[-4000:] = bytes(4000)
    assert (range_coder.decode_block(bytes(torn), 0) == got[0]).all()
    with pytest.raises(ValueError):
        range_coder.decode_block(bytes(torn), blocks - 1)
    with pytest.raises(ValueError):
        range_coder.encode_file(np.array([1]), np.array([0]), np.array([1]), np.array([65535]))


def test_words_cut_as_the_pattern_cuts():
    import regex

    rng = np.random.default_rng(4)
    alphabet = list("aZ stmdrevl'''  \n\t09.!é×ªÿ") + ["'re", "'ll x", " 's", "''s"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(4000)]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts])
    begin = token_output.word_starts(codes, np.cumsum(sizes) - sizes)
    expected = [s + m.start() for t, s in zip(texts, np.cumsum(sizes) - sizes, strict=True) for m in regex.finditer(token_output.PATTERN, t)]
    assert begin.tolist() == expected


def test_other_tokenizers(spark):
    """A tokenizer of another kind is given whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, texts = Tokenizer.from_file(path), ["Two words, don't you", "", "é x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_output.token_output(d, path, 2).collect()}
    for i, x in enumerate(texts):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
