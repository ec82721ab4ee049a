"""Queries that have no SQL, against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tabwarden.operators import dependencies
from tabwarden.plans import catalog, cleaning

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


def psi(n):
    return -0.5772156649015329 + np.append(0, np.cumsum(1 / np.arange(1, n.max() + 1)))[n - 1]


def information(x, v, k=3):
    """Every row's radius and neighbours, by sorted arrays."""
    nx = pd.Series(x).map(pd.Series(x).value_counts()).to_numpy()
    ki, r = np.minimum(k, nx - 1), np.zeros(len(v))
    for c in np.unique(x):
        own = np.flatnonzero(x == c)
        for i in own:
            r[i] = np.partition(np.abs(v[own] - v[i]), ki[i])[ki[i]]
    line = np.sort(v)
    inside = np.where(r > 0, np.searchsorted(line, v + r, "left") - np.searchsorted(line, v - r, "right"), np.searchsorted(line, v, "right") - np.searchsorted(line, v, "left"))
    return max(float(psi(np.array([len(v)]))[0] + np.mean(psi(ki) - psi(nx) - psi(inside))), 0)


def test_dependency_table(spark):
    t = cleaning.lines(spark, SF).toPandas()
    numbers, kinds = ("quantity", "price", "tax"), ("returnflag", "linestatus")
    want = {}
    for i, a in enumerate((*numbers, *kinds)):
        for b in (*numbers, *kinds)[i + 1 :]:
            both = t[[a, b]].dropna()
            if len(both) < 10:
                continue
            if b in numbers:
                score = abs(both[a].rank().corr(both[b].rank()))
            elif a in kinds:
                o = pd.crosstab(both[a], both[b]).to_numpy().astype(float)
                e = o.sum(axis=1, keepdims=True) * o.sum(axis=0) / o.sum()
                score = 1 - dependencies._upper_gamma((o.shape[0] - 1) * (o.shape[1] - 1) / 2, ((o - e) ** 2 / e).sum() / 2)
            else:
                score = information(both[b].to_numpy(), both[a].to_numpy(dtype=float))
            if score > 0.1:
                want[a, b] = score
    got = catalog.QUERIES["dependency_table"](spark, SF).collect()
    assert {(r["target"], r["predictor"]): r["score"] for r in got} == pytest.approx(want, abs=1e-4)
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True) and want


def grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f"_{w}_"
        out.update(w[i : i + 3] for i in range(max(len(w) - 2, 1)))
    return out


def test_lang_detect(spark, docs):
    profile = {}
    for _, t, lang in docs:
        if lang is not None:
            profile.setdefault(lang, Counter()).update(grams(t or ""))
    size = {lang: sum(c.values()) + len(c) for lang, c in profile.items()}
    got = {r["doc_id"]: r["lang"] for r in catalog.QUERIES["lang_detect"](spark, SF).collect()}
    for i, t, _ in docs:
        own = grams(t or "")
        scores = {lang: sum(n * math.log(c[g] + 1) for g, n in own.items()) - sum(own.values()) * math.log(size[lang]) for lang, c in profile.items()}
        known = own and any(g in c for g in own for c in profile.values())
        if t is None or len(t) < 3 or not known:
            assert got[i] == "unknown"
        else:
            best = max(scores.values())
            assert got[i] in {lang for lang, s in scores.items() if s > best - 1e-6}


def packed(text, most, overlap):
    whole = re.sub(r"[ \t\r\n\f]+", " ", text).strip(" ")
    sentences = [whole] if len(whole) < 5 else [s for s in (s.strip(" ") for s in re.sub(r"([.!?])[ \t\r\n\f]+", "\\1\x01", whole).split("\x01")) if s]
    out, now = [], ""
    for s in sentences:
        joined = s if not now else f"{now} {s}"
        if len(joined) <= most:
            now = joined
        else:
            if now:
                out.append(now)
            now = f"{now[-overlap:]} {s}" if overlap else s
    return out + ([now] if now else [])


@pytest.mark.parametrize(("name", "overlap"), [("chunks", 0), ("chunks_overlap", 100)])
def test_chunks(spark, docs, name, overlap):
    got = {}
    for r in catalog.QUERIES[name](spark, SF).collect():
        assert r["chunk_id"] == f"{r['doc_id']}_{r['chunk_no']}"
        got.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["chunk"]
    for i, t, _ in docs:
        want = packed(t, 800, overlap) if t is not None else []
        assert [got.get(i, {}).get(k) for k in range(len(want))] == want and len(got.get(i, {})) == len(want)


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_are_exact(spark, parts):
    from tabwarden.functions.ordered import quantiles

    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 9)), float(rng.standard_normal()), 5, None) for _ in range(501)] + [(None, 1e9, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, `c.d` int, e int").repartition(parts).withColumnRenamed("c.d", "c")
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = quantiles(df, ("a", "b", "c", "e"), shares).first()
    for c, i in (("a", 0), ("b", 1), ("c", 2)):
        own = [r[i] for r in rows if r[i] is not None]
        assert got[c]["n"] == len(own) and got[c]["q"] == pytest.approx([float(np.quantile(own, q)) for q in shares])
    assert got["e"]["n"] == 0 and got["e"]["q"] is None
    assert quantiles(df.limit(0), ("a", "b"), shares).first()["a"]["n"] == 0
