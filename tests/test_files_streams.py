import json

from tabwarden.operators import pii
from tabwarden.sources import files
from tabwarden.streaming import batches


def test_wrapped_csv_and_delimiter(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿"id;name"\n"1;x"\n"2;y"\n')
    assert files.delimiter(spark, str(p)) == ";"
    got = files.read_wrapped_csv(spark, str(p), "id string, name string", ";")
    assert sorted(map(tuple, got.collect())) == [("1", "x"), ("2", "y")]


def test_sniff(spark, tmp_path):
    (tmp_path / "a.xls").write_text("a,b\n1,2\n")
    (tmp_path / "b.xls").write_bytes(bytes.fromhex("d0cf11e0a1b11ae1") + b"x")
    (tmp_path / "c.htm").write_text("<html><table></table></html>")
    kinds = {r["name"]: r["kind"] for r in files.sniff(spark, str(tmp_path)).collect()}
    assert kinds == {"a.xls": "text", "b.xls": "ole2", "c.htm": "html"}


def test_audit_tail_keeps_bad_lines(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"ts":"2024-01-01","dataset":"d"}\nnot json\n{"ts":"2024-01-02","dataset":"e"}\n')
    rows = files.read_audit(spark, str(p), "ts string, dataset string", 2).collect()
    assert [r["dataset"] for r in rows] == ["e", "d"]
    assert files.read_audit(spark, str(p), "ts string, dataset string", 9).where("raw IS NOT NULL").count() == 1


def test_replay_and_assemble(spark, tmp_path):
    rows = spark.createDataFrame([("d", "b1", 1), ("d", "b1", 2), ("d", "b2", 3)], "dataset string, batch_id string, v long")
    src, out, chk = tmp_path / "in", tmp_path / "out", tmp_path / "chk"
    batches.replay(rows).write.text(str(src))
    with open(src / "bad.txt", "w") as f:
        f.write("{broken\n")
    good, bad = batches.parse(spark.readStream.format("text").load(str(src)))
    q = good.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(chk)).trigger(availableNow=True).start()
    q.awaitTermination()
    done = batches.assembled(spark.read.parquet(str(out)))
    got = {(r["batch_id"]): (r["n_rows"], r["complete"]) for r in done.collect()}
    assert got == {"b1": (2, True), "b2": (1, True)}


def test_route_stream(spark, tmp_path):
    src = tmp_path / "raw"
    spark.createDataFrame([(json.dumps({"text": "a"}),), ("plain",), (json.dumps({"z": 1}),)], "value string").write.text(str(src))
    routed = batches.route(spark.readStream.format("text").load(str(src)))
    q = routed.writeStream.format("memory").queryName("routed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["topic"] for r in spark.table("routed").collect()) == ["detected_text", "detected_text"]


def test_spans_and_overlaps(spark):
    df = spark.createDataFrame([(1, "é call 0771234567 or 4111111111111111"), (2, None)], "doc_id long, text string")
    rows = {(r["entity"], r["value"]): (r["start"], r["end"]) for r in pii.entities(df, "doc_id", "text").collect()}
    assert rows[("PHONE_NUMBER", "0771234567")] == (7, 17)
    assert ("CREDIT_CARD", "4111111111111111") in rows and not any(k[0] == "BANK_ACCOUNT" for k in rows)
