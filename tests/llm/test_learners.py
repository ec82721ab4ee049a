"""What language identification and the quality classifier learn, against plain versions and with texts that repeat."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwarden.llm import language_id, quality
from tabwarden.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark):
    """A third language of which three texts have 5,000 copies each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    xx = ["zuqo vrix kwaj zuqo plix", "wrux zajq vrix qopi zuqo kwaj", "plix plix kwaj vrix zuqo jjaq wrux"]
    more = spark.range(15000).select((F.col("id") + 10**6).alias("doc_id"), F.element_at(F.array(*map(F.lit, xx)), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit("xx").alias("lang"))
    return docs.unionByName(more)


def test_a_label_of_many_copies_is_learned(repeated):
    found = language_id.identify(repeated, F.lit(True))
    assert found.where("doc_id >= 1000000").groupBy("lang_nearest").count().collect() == [("xx", 15000)]
    langs, centres, _, _ = language_id.fit(repeated.select(F.lower("text").alias("text"), "lang").where("text IS NOT NULL"))
    assert set(langs) == {"de", "en", "es", "fr", "xx"} and langs.count("xx") == 3 and np.isfinite(centres).all()


def grams(text):
    """Counts of hashed runs of two and three bytes."""
    raw = [c + 32 if 65 <= c <= 90 else 32 if c < 65 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in text.lower().encode()]
    m = 0xFFFFFFFF
    out = Counter()
    for i in range(len(raw) - 1):
        two = (raw[i] * 0x9E3779B1 & m) ^ (raw[i + 1] * 0x85EBCA77 & m)
        out[(two * 0xC2B2AE3D & m) >> 20] += 1
        if i + 2 < len(raw):
            out[(((two * 0x27D4EB2F & m) ^ (raw[i + 2] * 0x165667B1 & m)) * 0xC2B2AE3D & m) >> 20] += 1
    return out


def test_op2_is_the_nearest_of_centroids_fitted_in_plain_python(spark):
    """With fewer than `sample` texts a language, every one is in the fit; TF-IDF and cosines are computed anew."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    letter = lambda t: t is not None and any(c.isalpha() for c in t)
    train = [r for r in docs if not held(r["doc_id"]) and r["lang"] is not None and letter(r["text"])]
    df = Counter(g for r in train for g in grams(r["text"]))
    idf = lambda g: math.log((1 + len(train)) / (1 + df[g])) + 0.1

    def vector(text):
        v = {g: math.log1p(n) * idf(g) for g, n in grams(text).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {g: x / size for g, x in v.items()}

    labelled = spark.createDataFrame([(r["text"].lower(), r["lang"]) for r in train], "text string, lang string")
    langs, centres, _, _ = language_id.fit(labelled)
    # a centroid is the scaled sum of the texts that are nearest to it
    near = {}
    for r in {(r["text"], r["lang"]): r for r in train}.values():
        v = vector(r["text"])
        own = [k for k, lang in enumerate(langs) if lang == r["lang"]]
        k = max(own, key=lambda k: sum(x * centres[k][g] for g, x in v.items()))  # noqa: B023
        near.setdefault(k, np.zeros(language_id.DIMENSIONS))
        for g, x in v.items():
            near[k][g] += x
    for k, total in near.items():
        assert float(total / np.linalg.norm(total) @ centres[k]) > 0.995
    got = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        v = vector(r["text"]) if letter(r["text"]) else None
        cosines = [sum(x * float(c[g]) for g, x in v.items()) for c in centres] if v else []
        g = got[r["doc_id"]]
        assert g["held_out"] == held(r["doc_id"])
        if not v:
            assert (g["lang_pred"], g["score"]) == ("und", 0)
        else:
            best = max(cosines)
            assert g["score"] == pytest.approx(best, abs=1e-4)
            assert g["lang_pred"] in {langs[k] for k, c in enumerate(cosines) if c > best - 1e-4}


def test_a_table_of_few_texts_still_has_a_classifier(spark):
    good = "The river runs slowly through the old town, and people walk along it in the evening. They talk, and they are glad."
    bad = ["BUY NOW!!! CHEAP $$$ CLICK | CLICK | CLICK | CLICK!!!", "### @@@ WIN WIN WIN WIN !!! $$$ <<<>>> | | | |"]
    docs = spark.range(60000).select(F.col("id").alias("doc_id"), F.element_at(F.array(F.lit(good), *map(F.lit, bad)), (F.col("id") % 3 + 1).cast("int")).alias("text"))
    got = {tuple(r) for r in quality.classify(docs).select(F.col("doc_id") % 3, F.round("score", 3), "kept").distinct().collect()}
    assert {k: kept for k, _, kept in got} == {0: True, 1: False, 2: False} and len(got) == 3


def plain_label_model(found, rounds):
    """Expectation-maximisation with loops over patterns and labellers."""
    k = len(quality.LABELLERS)
    vote = {c: [c // 3**j % 3 for j in range(k)] for c in found}
    good = {c: 0.1 if 1 in vote[c] else 0.9 for c in found}
    for _ in range(rounds):
        table = {}
        for y in (0, 1):
            weight = {c: n * (good[c] if y else 1 - good[c]) for c, n in found.items()}
            for j in range(k):
                for v in range(3):
                    table[y, j, v] = (sum(w for c, w in weight.items() if vote[c][j] == v) + 0.1) / (sum(weight.values()) + 0.3)
        prior = min(max(sum(n * good[c] for c, n in found.items()) / max(sum(found.values()), 1), 0.01), 0.99)
        for c in found:
            log = [math.log(prior if y else 1 - prior) + sum(math.log(table[y, j, v]) for j, v in enumerate(vote[c])) for y in (0, 1)]
            good[c] = 1 / (1 + math.exp(min(max(log[0] - log[1], -50), 50)))
    return good


def test_posteriors_are_those_of_plain_expectation_maximisation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    found = {r["pattern"]: r["n"] for r in quality.patterns(docs).collect()}
    for rounds in (1, 3, 100):
        assert quality.label_model(found, rounds)[0] == pytest.approx(plain_label_model(found, rounds), abs=1e-9)


def test_op7_scores_are_those_of_a_scorer_fitted_in_one_place(spark):
    """All distinct texts are in the sample here; the scorer is fitted again from texts in the driver and applied to them one by one."""
    import pandas as pd
    from tabwarden.llm import bytetext
    import pyarrow as pa

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", F.xxhash64(F.col("text")).alias("h")).collect()
    posterior, _ = quality.label_model({r["pattern"]: r["n"] for r in quality.patterns(docs.select("text")).collect()})

    def features(text):
        _, _, raw, offsets = next(iter(bytetext.chunks(pa.array([text], pa.string()))))
        n, values = quality.statistics(raw, offsets)
        code = int((quality.votes(values) @ 3 ** np.arange(len(quality.LABELLERS)))[0])
        return int(n[0]), quality._features(raw, offsets, values)[0], posterior.get(code, 0.5)

    kinds = {r["text"]: r["h"] for r in rows if r["text"] and r["text"].split()}
    assert len(kinds) < quality.SAMPLE
    train = [(h, *features(t)[1:]) for t, h in kinds.items()]
    w = quality._fit(pd.DataFrame({"h": [t[0] for t in train], "x": [t[1].tobytes() for t in train], "y": [t[2] for t in train]}))
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_classifier"](spark, SF).collect()}
    for r in rows:
        n, x, label = features(r["text"] or "")
        want = 1 / (1 + math.exp(-(float(x @ w[:-1]) + float(w[-1])))) if n else 0.0
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-4) and got[r["doc_id"]]["kept"] == (got[r["doc_id"]]["score"] >= 0.3)
        assert got[r["doc_id"]]["label_posterior"] == pytest.approx(label if n else 0.0, abs=1e-9)
