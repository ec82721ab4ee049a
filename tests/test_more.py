"""Operators on small tables with known answers."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tabwarden.functions import normalise as N
from tabwarden.operators import dependencies, drift, fixes, matching, pii, profile, protect, registry, text
from tabwarden.sources import files
from tabwarden.streaming import batches

SF = "/root/testdata/sf0.001"
ROWS = 40


def sensor_batches(spark):
    """A canonical batch and one each that drops, renames and adds columns."""
    out = []
    for i in range(ROWS):
        v1 = {"timestamp": f"2024-03-{i % 28 + 1:02d} 10:00:{i % 60:02d}", "sensor_id": f"S{i % 3}", "temperature_c": f"{20 + i % 7 * 0.7:.1f}", "humidity_percent": f"{40 + i % 11 * 0.9:.1f}", "sensor_status": ("OK", "WARN", "FAIL")[i % 3], "battery_level": str(90 - i % 20)}
        v2 = {k: v for k, v in v1.items() if k != "battery_level"}
        names = {"temperature_c": "temp_celsius", "humidity_percent": "rel_humidity", "sensor_status": "status"}
        v3 = {names.get(k, k): v for k, v in v1.items()}
        v4 = v1 | {"firmware_version": f"1.{i % 3}.0"}
        out += [("sensors", b, i, p) for b, p in (("v1", v1), ("v2", v2), ("v3", v3), ("v4", v4))]
    return spark.createDataFrame(out, "dataset string, batch_id string, row_no long, payload map<string,string>")


@pytest.fixture(scope="module")
def sensors(spark):
    rows = sensor_batches(spark)
    facts = profile.column_facts(rows).cache()
    canonical = facts.where("batch_id = 'v1'").select("dataset", "column", "type", "nullable")
    found = drift.changes(canonical, facts)
    baseline = profile.baseline(canonical, facts.where("batch_id = 'v1'"), profile.frequent_values(rows.where("batch_id = 'v1'"), as_array=True))
    scored = matching.candidates(found, baseline, facts, profile.first_values(rows))
    return facts, found, scored


def test_sensor_batches(sensors):
    facts, found, scored = sensors
    renames = matching.assign(scored)
    assert {(r["batch_id"], r["old_name"], r["new_name"]) for r in renames.collect()} == {("v3", "temperature_c", "temp_celsius"), ("v3", "humidity_percent", "rel_humidity"), ("v3", "sensor_status", "status")}
    types = {r["batch_id"]: r["drift_types"] for r in drift.report(facts, drift.with_renames(found, renames)).collect()}
    assert types == {"v1": "", "v2": "REMOVE", "v3": "RENAME", "v4": "ADD"}


def test_learned_scores_tell_true_pairs(spark):
    from tabwarden.plans import catalog

    true = {("c_name", "fullname"), ("c_acctbal", "account_balance"), ("c_custkey", "customer_id"), ("c_acctbal", "balance_usd"), ("c_mktsegment", "segment")}
    rows = [r for r in catalog.QUERIES["match_learned"](spark, SF).collect() if r["dataset"] in ("d1", "d3")]
    assert rows and all((r["score"] > 0.5) == ((r["old_name"], r["new_name"]) in true) for r in rows)


def test_drift_plans_read_rows_once(spark, sensors):
    from tabwarden.plans import catalog

    plan = catalog.QUERIES["drift_report"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and plan.count("events.parquet") == 0


def test_heuristic_threshold():
    assert [matching.heuristic_threshold(x) for x in (0.5359877, 0.6, 0.72)] == [0.58, 0.6, 0.66]


def test_decisions_by_data_set_and_batch(spark):
    staged = spark.createDataFrame([("a", "b1", 1), ("b", "b1", 2), ("b", "b2", 3)], "dataset string, batch_id string, row_no long")
    decisions = spark.createDataFrame([("a", "b1", "reject", "x", "bad", 1), ("a", "b1", "approve", "y", None, 2), ("b", "b1", "reject", "x", "no", 1)], "dataset string, batch_id string, decision string, actor string, reason string, at int")
    got = {r["row_no"]: (r["place"], r["status"], r["decided_by"], r["reject_reason"]) for r in registry.apply_decisions(staged, decisions).collect()}
    assert got == {1: ("production", "PROMOTED", "y", None), 2: ("rejected", "REJECTED", "x", "no"), 3: ("staging", "PENDING", None, None)}


def test_candidates_wait_for_approval(spark):
    known = registry.canonical_versions(spark.createDataFrame([("d", "h0")], "dataset string, schema_hash string"))
    hashes = spark.createDataFrame([("d", "b1", "h1"), ("d", "b2", "h0"), ("d", "b3", "h2")], "dataset string, batch_id string, schema_hash string")
    reg = registry.with_candidates(known, hashes)
    assert {(r["schema_hash"], r["version"], r["status"]) for r in reg.collect()} == {("h0", 1, "active"), ("h1", 2, "candidate"), ("h2", 3, "candidate")}
    then = hashes.withColumn("active_hash", F.lit("h0"))
    decide = lambda *d: {r["schema_hash"]: r["status"] for r in registry.activated(reg, then, spark.createDataFrame([("d", *x) for x in d], "dataset string, batch_id string, decision string, at int")).collect()}
    assert decide(("b1", "approve", 1)) == {"h0": "retired", "h1": "active", "h2": "candidate"}
    assert decide(("b1", "reject", 1)) == {"h0": "active", "h1": "candidate", "h2": "candidate"}
    assert decide(("b1", "approve", 1), ("b3", "rollback", 2)) == {"h0": "active", "h1": "retired", "h2": "candidate"}


def test_utc_in_other_zones(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        t = spark.createDataFrame([("2024-01-01T00:00:00Z",)], "s string").select(N.utc_iso(F.col("s").cast("timestamp")).alias("u"))
        assert t.first()["u"] == "2024-01-01T00:00:00.000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_last_fix_of_a_cell(spark):
    t = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k long, n int, s string")
    f = spark.createDataFrame([(1, "n", "9", 1), (1, "n", "10", 2), (2, "s", "x", 1), (2, "s", None, 2)], "row_id long, column string, value string, made int")
    assert sorted(map(tuple, fixes.apply_fixes(t, f, "k", ("n", "s")).collect())) == [(1, 10, "a"), (2, 6, None)]


@pytest.mark.parametrize(("a", "x", "q"), [(1.0, 1.0, 0.36787944), (0.5, 1.92072941, 0.05), (2.5, 5.5352, 0.05), (5.0, 2.0, 0.94734698), (2.0, 0.0, 1.0)])
def test_upper_gamma(a, x, q):
    assert dependencies._upper_gamma(a, x) == pytest.approx(q, abs=1e-4)


def test_importance(spark):
    rows = [(i % 7, (i * 31) % 11, "hi" if i % 7 > 3 else "lo") for i in range(600)]
    t = spark.createDataFrame([(float(a), float(b), c) for a, b, c in rows], "x double, y double, t string")
    model = fixes.train_imputer(t, "t", ("x", "y"), (), True)
    got = {r["feature"]: r["importance"] for r in fixes.permutation_importance(model, t, "t", ("x", "y")).collect()}
    assert got["x"] > 0.2 and abs(got["y"]) < 0.05


@pytest.mark.parametrize(("unit", "f"), [("x", lambda c: F.size(pii.detect(c))), ("<", text.strip_html), ("a.", lambda c: F.size(pii.detect(c))), ("<a ", text.strip_html)])
def test_long_texts_in_linear_time(spark, unit, f):
    began = time.time()
    spark.createDataFrame([(unit * (1_000_000 // len(unit)),)], "t string").select(f(F.col("t"))).collect()
    assert time.time() - began < 30


def test_ordinary_quoted_rows_stay(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,b,c\n"x, y",1,"z"\n"p,q,""r"""\na,b,c\n')
    got = files.read_wrapped_csv(spark, str(p), "a string, b string, c string")
    assert sorted(map(tuple, got.collect())) == [("a", "b", "c"), ("p", "q", "r"), ("x, y", "1", "z")]


def test_code_pages(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("﻿né €".encode())
    (tmp_path / "w.txt").write_bytes("né €".encode("cp1252"))
    assert {r["text"] for r in files.read_documents(spark, str(tmp_path)).collect()} == {"né €"}


def test_row_lists(spark):
    body = json.dumps({"dataset": "d", "batch_id": "b", "rows": [{"x": 1}, {"x": "2", "y": None}]})
    t = files.ingest_rows(spark.createDataFrame([(body,), ("no",), ('{"rows":[]}',)], "body string"))
    assert sorted((r["row_no"], r["payload"]) for r in t.collect()) == [(0, {"x": "1"}), (1, {"x": "2", "y": None})]


def test_stored_by_data_set(spark, tmp_path):
    for d in ("a", "b"):
        files.store(spark.createDataFrame([(d, 1)], "dataset string, n int"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("dataset = 'b'").count() == 1


def test_passwords(spark):
    import hashlib

    t = spark.createDataFrame([("secret",), (None,)], "p string").select(protect.password_hash(F.col("p"), "salt").alias("h"))
    assert {r["h"] for r in t.collect()} == {hashlib.pbkdf2_hmac("sha256", b"secret", b"salt", 10_000).hex(), None}


def test_flush_is_idempotent(spark, tmp_path):
    out = str(tmp_path / "out")
    shape = "dataset string, batch_id string, type string, payload map<string,string>"
    spark.createDataFrame([], shape + ", flush_no int, epoch int").write.parquet(out)
    handle = batches.flush(lambda rows, _: rows.write.mode("append").parquet(out), lambda: spark.read.parquet(out).select("dataset", "batch_id", "flush_no", "epoch").distinct())
    rows = spark.createDataFrame([("d", "b", None, {"x": "1"}), ("d", "b", "end_batch", None), ("d", "open", None, {"x": "2"})], shape)
    for epoch in (0, 0, 1):
        handle(rows, epoch)
    assert sorted((r["batch_id"], r["flush_no"], r["epoch"]) for r in spark.read.parquet(out).collect()) == [("b", 0, 0), ("b", 1, 1)]


def test_text_stream_and_topics(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("<b>Hi</b> there. You!",), (json.dumps({"text": "12"}),)], "value string").write.text(str(src))
    cleaned = batches.clean_texts(spark.readStream.format("text").load(str(src)))
    batches.topic_sink(cleaned, str(tmp_path / "chk"), "json", path=str(out)).trigger(availableNow=True).start().awaitTermination()
    got = {json.loads(r["value"])["clean_text"]: json.loads(r["value"])["status"] for r in spark.read.json(str(out)).collect()}
    assert got == {"Hi there. You!": "cleaned", "12": "partial"}


def test_idle_batches_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([("d", "b", "2024-01-01 00:00:00"), ("d", "b", "2024-01-01 00:00:05"), ("d", "b", "2024-01-01 00:00:30"), ("d", "z", "2024-01-01 01:00:00")], "dataset string, batch_id string, ts string")
    src = str(tmp_path / "in")
    rows.write.json(src)
    stream = spark.readStream.schema("dataset string, batch_id string, ts timestamp").json(src)
    q = batches.idle_batches(stream).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n_rows"] for r in spark.table("idle").where("batch_id = 'b'").collect()) == [1, 2]
    assert {(r["batch_id"], r["sent"]) for r in batches.replay_counts(rows).collect()} == {("b", 4), ("z", 2)}


def test_small_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Column,dtype,min,max\nage,integer,0,120\n")
    assert files.read_rules(spark, str(tmp_path / "r.csv")).first()["max"] == "120"
    (tmp_path / "p.json").write_text(json.dumps({"policies": [{"entity": "NIC", "sensitivity_level": "High", "source": "law.pdf"}]}))
    assert files.read_policies(spark, str(tmp_path / "p.json")).first()["source_file"] == "law.pdf"
    (tmp_path / "t.csv").write_text("text,source\n a ,\n,x\nb,web\n")
    assert sorted(map(tuple, files.read_text_records(spark, str(tmp_path / "t.csv")).collect())) == [("a", "unknown"), ("b", "web")]
    files.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "o"), ["b", "a"])
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 1
    d = spark.createDataFrame([(1, None, 2)], "` a` int, `Unnamed: 1` string, `Unnamed: 2` int")
    assert files.drop_unnamed(d).columns == ["a", "Unnamed: 2"]
    assert files.catalogue(spark, str(tmp_path / "t.csv")).first()["rows"] == 4
