"""The registered queries: the columns of their contracts, and results held against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tabwarden.llm import queries

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op6_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op11_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
}


@pytest.fixture(scope="module")
def results(spark):
    cache = {}

    def get(name):
        if name not in cache:
            found = getattr(queries, name)(spark, SF)
            cache[name] = found.dtypes, found.collect()
        return cache[name]

    return get


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns(results, rows, name):
    types, found = results(name)
    types = dict(types)
    for column in CONTRACTS[name].split(", "):
        c, kind = column.split(" ")
        assert types[c] == kind
    assert sorted(r["doc_id"] for r in found) == sorted(rows)


def test_licenses(results, rows):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for r in results("op3_license_scan")[1]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), rows[r["doc_id"]]["text"] or ""))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


KINDS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


PARTS = ["PassWord", "api_key", "apikey", "token", "'", '"', " ", "  ", ":", "=", "abc", "AKIA", "AKIAABCDEFGHIJK", "ABCDEFGHIJKLMNOP", "LMNO1", "0123456789abcdef", "0123456789abcdef0123456", "deadbeef", "é", "漢字", "\U0001f600", "\n", "x.y-z/", "Secret = ", "passwd:", "hunter2!"]


def test_secrets(spark, tmp_path):
    """Counts and digest of made texts, with code points of two, three and four bytes before the spans."""
    r = random.Random(4)
    texts = [None, "", "nothing", "password=abc12", "password=abc123", *("".join(r.choices(PARTS, k=r.randrange(1, 40))) for _ in range(400))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    seen = Counter()
    for r in queries.op8_secret_scan(spark, str(tmp_path)).collect():
        text = texts[r["doc_id"]] or ""
        spans = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, (p, ok)) in enumerate(KINDS.items()) for m in re.finditer(p, text) if ok(m)]
        count = Counter(s[2].split(":")[0] for s in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(count[k] for k in KINDS), text
        assert r["base_sha256"] == hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest(), text
        assert {s[2] for s in spans} <= set(r["spans"].split(","))
        seen += count
    assert all(seen[k] > 20 for k in KINDS)


def targets(sizes):
    """{source: target} by taking the capped sources out one round after the other."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    whole, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, total = whole - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 3 * sizes[s] for s in over})


def test_mix(results, rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in rows.items()}
    sizes, taken = Counter(), Counter()
    found = results("op6_source_mixing")[1]
    for i, r in rows.items():
        sizes[r["source"]] += size[i]
    expected = targets(sizes)
    for r in found:
        source = rows[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[source]) and r["target"] == pytest.approx(expected[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 0.01 * expected[s] + max(v for i, v in size.items() if rows[i]["source"] == s)


def test_languages(results, rows):
    """Nearly every held-out text gets its language, though lang is no input."""
    held = [r for r in results("op2_language_id")[1] if r["held_out"] and rows[r["doc_id"]]["lang"] is not None]
    assert sum(r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in held) > 0.95 * len(held) and held
    assert all(r["lang_pred"] == "und" for r in results("op2_language_id")[1] if not re.search(r"[^\W\d_]", rows[r["doc_id"]]["text"] or ""))
