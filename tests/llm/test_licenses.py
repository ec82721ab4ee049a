"""Licence templates held against a plain version, and the work that more templates cost."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tabwarden.llm import bytetext, license_scan


def plain(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, templates, coverage=0.6, near=license_scan.NEAR):
    """{(label, start): coverage} by comparing each template at each start."""
    w, found = plain(text), {}
    for label, t, need in templates:
        t, need = plain(t), [plain(p) for p in need]
        for s in range(-len(t), len(w)):
            share = sum(1 for k, x in enumerate(t) if 0 <= s + k < len(w) and w[s + k] == x) / len(t)
            near_by = lambda p, s=s, t=t: any(w[x : x + len(p)] == p for x in range(max(0, s - near), min(len(w), s + len(t) + near) - len(p) + 1))
            if share >= coverage and all(near_by(p) for p in need):
                found[label, s] = max(share, found.get((label, s), 0.0))
    return found


def made(seed, n=150):
    """Copies of licences, whole, cut off, with words changed, beside and inside each other."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(1, 5)):
            t = r.choice(license_scan.TEMPLATES)[1].split()
            if r.random() < 0.4:
                lo = r.randrange(len(t))
                t = t[lo:] if r.random() < 0.5 else t[: lo + 1]
            t = [r.choice(["license", "the", "other", x]) if r.random() < 0.1 else x for x in t]
            parts += [*t, *r.choices(["license", "public", "mit", "word", "and"], k=r.randrange(4))]
        out.append(" ".join(x.upper() if r.random() < 0.2 else x for x in parts))
    return out


ODD = [None, "", " .. ", "license", "mit license " * 300, "under the mit license", "licensed under cc by nc 4 0 licensed under the gnu lesser general public license", "x" * 70000, "licensed under the apache license version 2 0 " * 40]


@pytest.mark.parametrize("coverage", [0.3, 0.6, 1.0])
def test_templates_against_every_start(spark, coverage):
    texts = ODD + made(5)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS matches", "'x' AS label")
    got = {r["doc_id"]: {(m["label"], m["start_word"]): m["coverage"] for m in r["matches"]} for r in license_scan.scan(d.select("doc_id", "text", "label"), coverage=coverage).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute(t, license_scan.TEMPLATES, coverage)), t


def more_templates(n):
    r = random.Random(1)
    rare = [f"{a}{b}" for a in ("li", "cen", "soft", "war") for b in range(500)]
    out = []
    for k in range(n):
        t = r.choices(rare, k=20) + r.choices(["license", "software", "the", "of", "public"], k=10)
        out.append((f"made-{k}", " ".join(t), (" ".join(t[3:6]),)))
    return out


def test_other_templates_cost_nothing():
    """With 2,000 templates more the same places are found by as many comparisons of words."""
    work = []
    column = pa.array(made(7) + ODD)
    for templates in (license_scan.TEMPLATES, (*license_scan.TEMPLATES, *more_templates(2000))):
        index = license_scan._Index(templates, license_scan.BASE_PHRASES)
        common = {"license", "software", "the", "of", "public", "and", "to"}
        index.post(np.array([1.0 if w in common else 5.0 for w in index.words]), 0.6)
        found = []
        for first, _, raw, offsets in bytetext.chunks(column):
            w = bytetext.words(raw, offsets, bytetext.NOT_ALPHANUMERIC)
            coded = index.encode(w.hashes)
            found += [(first + t, index.labels[k], s, c) for t, k, s, c in index.places(coded, w.first, *index.occurrences(coded, w.first))]
        work.append((sorted(found), index.compared))
    assert work[0] == work[1] and work[0][0]


def test_small_passes(monkeypatch):
    monkeypatch.setattr(license_scan, "PASS", 50)
    index = license_scan._Index(license_scan.TEMPLATES, license_scan.BASE_PHRASES).post(np.ones(300), 0.6)
    for t in made(9, 30):
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        w = bytetext.words(raw, np.array([0, len(raw)]), bytetext.NOT_ALPHANUMERIC)
        coded = index.encode(w.hashes)
        got = {}
        for _, k, s, c in index.places(coded, w.first, *index.occurrences(coded, w.first)):
            got[index.labels[k], s] = max(c, got.get((index.labels[k], s), 0.0))
        assert got == pytest.approx(brute(t, license_scan.TEMPLATES))


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("own", "Free as in beer, with no strings", ["no strings"]), (None, "x", ["x"]), ("gone", None, ["x"])], "label string, text string, phrases array<string>")
    templates = license_scan.template_table(table)
    assert len(templates) == 1
    d = spark.createDataFrame([(1, "it is free as in beer with no strings"), (2, "no strings")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(d, templates=templates).collect()} == {1: "own", 2: ""}
    assert license_scan.scan(d, templates=[], phrases={}).where("labels != '' OR n_base > 0").count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(d, templates=[("a", "b c", ())])
