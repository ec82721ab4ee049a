"""Personal data: overlaps, findings of whole documents and redaction against plain Python; long texts in time."""

import hashlib
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import pii, protect
from tabwarden.plans import catalog, texts

SF = "/root/testdata/sf0.001"


def rank(entity):
    return pii.PRIORITY.get(entity, 10)


def settle(spans):
    """Every newcomer against all that stay, as the rule says."""
    kept = []
    for s in sorted(spans, key=lambda s: (s["start"], -rank(s["entity"]), -s["confidence"], s["entity"], s["value"], s["end"])):
        clash = [o for o in kept if o["start"] < s["end"] and s["start"] < o["end"]]
        if all((rank(s["entity"]), s["confidence"]) > (rank(o["entity"]), o["confidence"]) for o in clash):
            kept = [o for o in kept if o not in clash] + [s]
    return kept


def normal(entity, value):
    return "".join(c for c in value if c.isdecimal()) if entity in ("PHONE_NUMBER", "CREDIT_CARD", "BANK_ACCOUNT") else value.strip(" ").lower()


@pytest.fixture(scope="module")
def found(spark):
    """What the detectors find, settled and freed of repeats in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_doc = {}
    for r in pii.entities(docs, "doc_id", "text", resolved=False).collect():
        by_doc.setdefault(r["doc_id"], []).append(r.asDict())
    out = []
    for i, spans in by_doc.items():
        seen = {}
        for s in sorted(settle(spans), key=lambda s: (-s["confidence"], s["start"])):
            seen.setdefault((s["entity"], normal(s["entity"], s["value"])), s)
        out += [(i, s["entity"], s["value"], s["start"], s["end"], s["confidence"]) for s in seen.values()]
    return sorted(out)


def test_pii_resolved(spark, found):
    assert sorted(map(tuple, catalog.QUERIES["pii_resolved"](spark, SF).collect())) == found and len(found) > 10


def test_spans_are_where_they_say(spark, found):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(docs[i][a:b] == v for i, _, v, a, b, _ in found)


def method(entity):
    levels = {}
    for e, level in texts.POLICIES:
        levels[e] = max(levels.get(e, level), level, key=lambda x: pii.SENSITIVITY[x])
    return levels.get(entity)


def test_pii_statistics(spark, found):
    got = catalog.QUERIES["pii_statistics"](spark, SF).collect()
    assert Counter({e: sum(r["n"] for r in got if r["entity"] == e) for e in {r["entity"] for r in got}}) == Counter(e for _, e, *_ in found)
    assert all(r["sensitivity_level"] == method(r["entity"]) for r in got if method(r["entity"]))


def test_redact_text(spark, found):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    how = {(r["doc_id"], r["value"]): r["method"] for r in texts._protected(spark, SF).select("doc_id", "value", "method").collect()}
    mask = lambda v: "*" * len(v) if len(v) <= 4 else v[:2] + "*" * (len(v) - 4) + v[-2:]
    sha = lambda salt, v: hashlib.sha256((salt + v).encode()).hexdigest()
    safe = {"mask": mask, "hash": lambda v: sha("salt", v), "encrypt": lambda v: sha("cipher", v), "tokenize": lambda v: "TKN_" + sha("0123456789abcdef", v)[:32]}
    by_doc = {}
    for i, _, v, *_ in found:
        by_doc.setdefault(i, []).append(v)
    for r in catalog.QUERIES["redact_text"](spark, SF).collect():
        values = by_doc.get(r["doc_id"], [])
        assert r["n_protected"] == len(values)
        if not values:
            assert r["text"] == docs[r["doc_id"]]
        for v in values:
            assert safe[how[r["doc_id"], v]](v) in r["text"]
        if len(set(values)) == 1 and docs[r["doc_id"]].count(values[0]) == 1:
            assert r["text"] == docs[r["doc_id"]].replace(values[0], safe[how[r["doc_id"], values[0]]](values[0]))


def test_overlaps_of_many_spans(spark):
    import random

    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 400):
        spans = []
        for _ in range(n):
            start = rng.randrange(2 * n)
            spans.append({"entity": rng.choice(["NIC", "BANK_ACCOUNT", "DATE", "EMAIL", "OTHER"]), "value": "v", "start": start, "end": start + rng.randrange(1, 9), "confidence": rng.choice([0.4, 0.6, 0.9])})
        df = spark.createDataFrame([([tuple(s[k] for k in ("entity", "value", "start", "end", "confidence")) for s in spans],)], f"s array<{pii.SPAN}>")
        got = df.select(pii.resolve(F.col("s")).alias("s")).first()["s"]
        assert [tuple(s) for s in got] == [tuple(s.values()) for s in settle(spans)]


def test_many_matches_in_one_text(spark):
    n = 200_000
    began = time.time()
    df = spark.createDataFrame([("a1@b.com " * n,)], "t string")
    spans = df.select(F.explode(pii.resolve(pii.detect(F.col("t")))).alias("s")).agg(F.count("*").alias("n"), F.max("s.end").alias("e"), F.count_distinct("s.start").alias("d")).first()
    assert tuple(spans) == (n, 9 * n - 1, n) and time.time() - began < 60


def test_addresses_of_both_kinds_are_redacted(spark):
    d = spark.createDataFrame([(1, "from fe80::1 and 2001:db8:0:0:0:0:0:7 to 10.0.0.1 at 12:30:45, a::b::c"), (2, None)], "doc_id long, text string")
    assert {r["value"] for r in pii.entities(d, "doc_id", "text").where("entity = 'IP_ADDRESS'").collect()} == {"fe80::1", "2001:db8:0:0:0:0:0:7", "10.0.0.1"}


def test_passwords_are_stretched(spark):
    t = spark.createDataFrame([("secret", "hash_password"), ("secret", "hash"), (None, "hash_password")], "v string, m string")
    got = [r["p"] for r in t.select(protect.protected(F.col("v"), F.col("m"), "salt", "0123456789abcdef").alias("p")).collect()]
    assert got == [hashlib.pbkdf2_hmac("sha256", b"secret", b"salt", 10_000).hex(), hashlib.sha256(b"saltsecret").hexdigest(), None]


def test_dates_of_sixteen_formats(spark):
    from datetime import datetime

    formats = ["%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d %m %Y", "%d/%m/%y", "%d-%m-%y", "%d %m %y", "%Y-%m-%d", "%Y/%m/%d", "%Y %m %d", "%d %B %Y", "%d %b %Y", "%B %d %Y", "%B %d, %Y", "%b %d %Y", "%b %d, %Y"]
    days = [datetime(2024, 2, 29), datetime(1999, 12, 31), datetime(2005, 5, 7)]
    said = [d.strftime(f) for d in days for f in formats] + ["31/02/2024", "1-2/2024", "2024.1.5", "1.2.99", "5 Foo 2024", "5 Jan 99", "13/13/2024", "12345", "7/5/2005", "07 may 2005", ""]

    def plain(text):
        for f in formats:
            try:
                return datetime.strptime(text, f).strftime("%Y-%m-%d")
            except ValueError:
                pass

    got = {r["t"]: r["iso"] for r in spark.createDataFrame([(t,) for t in said], "t string").select("t", pii.to_iso(F.col("t")).alias("iso")).collect()}
    assert got == {t: plain(t) for t in said}
    spans = spark.createDataFrame([("due 7 5 2005, or May 7, 2005; not 1-2/2024",)], "t string").select(F.explode(pii.detect(F.col("t"), tuple(d for d in pii.DETECTORS if d.entity == "DATE"))).alias("s"))
    assert [r["value"] for r in spans.select("s.value").collect()] == ["7 5 2005", "May 7, 2005"]


def test_names_of_dates_come_before_numbers(spark):
    from tabwarden.operators import profile

    rows = spark.createDataFrame([("d", "b", i, {"ship_date": f"2024-01-{i + 1:02d}", "note": "x", "flag": "true", "amount_ts": str(i)}) for i in range(9)], "dataset string, batch_id string, row_no long, payload map<string,string>")
    assert {r["column"]: r["type"] for r in profile.column_facts(rows).collect()} == {"ship_date": "datetime", "note": "string", "flag": "bool", "amount_ts": "int"}
