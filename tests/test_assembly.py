"""Batches of a stream: nothing lost or repeated over micro-batches and restarts, and what follows each flush."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import drift, matching, profile, registry, risk
from tabwarden.operators.profile import BATCH
from tabwarden.streaming import assembly, batches

CANONICAL = [("d", "a", "int", False), ("d", "b", "string", True)]


def row(batch, dataset="d", **payload):
    return {"dataset": dataset, "batch_id": batch, "payload": {k: str(v) for k, v in payload.items()}}


def end(batch, dataset="d"):
    return {"dataset": dataset, "batch_id": batch, "type": "end_batch"}


class Feed:
    """Files of messages, a micro-batch each."""

    def __init__(self, spark, folder, shards=1, silence=None):
        self.spark, self.folder, self.shards, self.silence = spark, str(folder), shards, silence
        os.makedirs(f"{folder}/in")

    def put(self, name, *messages):
        with open(f"{self.folder}/{name}", "w") as f:
            f.writelines((m if isinstance(m, str) else json.dumps(m)) + "\n" for m in messages)
        os.rename(f"{self.folder}/{name}", f"{self.folder}/in/{name}")

    def start(self, handle=None):
        stream = self.spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(f"{self.folder}/in")
        held = assembly.assemble(batches.parse(stream)[0], self.silence, self.shards)
        out = held.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint")
        out = out.foreachBatch(handle) if handle else out.format("parquet").option("path", f"{self.folder}/out")
        return (out.trigger(availableNow=True) if self.silence is None else out.trigger(processingTime="200 milliseconds")).start()

    def run(self, handle=None):
        q = self.start(handle)
        assert q.awaitTermination(120)

    def rows(self):
        t = self.spark.read.schema(assembly.FLUSHED).parquet(f"{self.folder}/out")
        return sorted((r["batch_id"], r["flush_no"], json.loads(r["payload"])["a"], r["closed"]) for r in t.collect())


@pytest.mark.parametrize("shards", [1, 3])
def test_rows_wait_for_their_end_mark(spark, tmp_path, shards):
    feed = Feed(spark, tmp_path, shards)
    feed.put("1", row("x", a=1), row("x", a=2), row("y", a=9), "{broken", {"dataset": "d", "batch_id": "x"})
    feed.run()
    assert feed.rows() == []
    feed.put("2", row("x", a=3), row("z", a=7))  # after a restart
    feed.run()
    assert feed.rows() == []
    feed.put("3", end("x"), end("empty"))
    feed.run()
    first = [("x", 0, str(i), "end") for i in (1, 2, 3)]
    assert feed.rows() == first
    feed.put("4", row("x", a=4), row("y", a=8))
    feed.run()
    feed.put("5", end("x"), end("y"), end("y"))
    feed.run()
    assert feed.rows() == [*first, ("x", 1, "4", "end"), ("y", 0, "8", "end"), ("y", 0, "9", "end")]  # z is still open


def test_rows_after_an_end_mark_of_the_same_micro_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    shape = "dataset string, batch_id string, type string, payload map<string,string>, seq long"
    data = [("d", "x", None, {"a": "1"}, 1), ("d", "x", "end_batch", None, 2), ("d", "x", None, {"a": "2"}, 3), ("d", "x", "end_batch", None, 4), ("d", "x", "end_batch", None, 5), ("d", "x", None, {"a": "3"}, 6)]
    spark.createDataFrame(data, shape).coalesce(1).write.parquet(src)
    held = assembly.assemble(spark.readStream.schema(shape).parquet(src), None)
    q = held.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r["flush_no"], r["payload"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, '{"a":"1"}'), (1, '{"a":"2"}')]


def test_silence_ends_a_batch_with_its_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path, silence=2.0)
    os.makedirs(tmp_path / "out")
    feed.put("1", row("x", a=1), row("x", a=2))
    q = feed.start()
    try:
        wait = lambda n: next((True for _ in range(300) if (time.sleep(0.2) or len(feed.rows()) >= n)), False)
        assert wait(2)
        feed.put("2", row("x", a=3))  # late
        assert wait(3)
    finally:
        q.stop()
    assert feed.rows() == [("x", 0, "1", "silence"), ("x", 0, "2", "silence"), ("x", 1, "3", "silence")]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Three flushes of a data set, in two epochs of which each is run twice; and one of a data set nobody knows."""
    folder = str(tmp_path_factory.mktemp("flushes"))
    known = lambda s: s.createDataFrame(CANONICAL, "dataset string, column string, type string, nullable boolean")
    base = lambda s: profile.baseline(known(s), s.createDataFrame([], "dataset string, column string, null_rate double, mean double, std double, min double, max double"), s.createDataFrame([], "dataset string, column string, examples array<string>"))
    shape = "dataset string, mode string, dataset_criticality string, sensitivity_class string, regulation_strictness string, key_fields array<string>"
    config = lambda s: risk.resolve_config(s.createDataFrame([("d", "A", "High", "PII", "Light", ["a"])], shape), s.createDataFrame([], shape))
    handle = assembly.write_flushes(folder, known, base, config)
    flushed = lambda *rows: spark.createDataFrame([(d, b, 0, f, i, json.dumps(p), "end") for d, b, f, i, p in rows], assembly.FLUSHED)
    one = flushed(*[("d", "x", 0, i, {"a": str(i), "b": "t"}) for i in range(5)], *[("d", "x", 1, i, {"a": "word", "c": "1"}) for i in range(3)], ("who", "x", 0, 0, {"a": "1"}))
    two = flushed(*[("d", "y", 0, i, {"a": str(i)}) for i in range(4)])
    seen = []
    for epoch, df in ((0, one), (0, one), (1, two), (0, one), (1, two)):
        handle(df, epoch)
        seen.append({t: sorted(map(str, assembly.table(spark, folder, t).collect())) for t in (*assembly.TABLES, "candidates", "unregistered")})
    return folder, seen, (known, base, config, one.unionByName(two))


def test_an_epoch_run_again_changes_nothing(written):
    _, seen, _ = written
    assert seen[0] == seen[1] and seen[2] == seen[3] == seen[4]
    assert all(len(seen[2][t]) > len(seen[0][t]) for t in assembly.TABLES) and len(seen[2]["unregistered"]) == 1


def test_tables_hold_what_batch_operators_say(spark, written):
    folder, _, (known, base, config, flushed) = written
    rows = flushed.where("dataset = 'd'").select("dataset", F.concat_ws("/", "batch_id", "flush_no").alias("batch_id"), "row_no", F.from_json("payload", "map<string,string>").alias("payload"))
    facts = profile.column_facts(rows).cache()
    found = drift.changes(known(spark), facts)
    renames = matching.assign(matching.candidates(found, base(spark), facts, profile.first_values(rows)))
    final = drift.with_renames(found, renames)
    batch = F.concat_ws("/", "batch_id", "flush_no").alias("batch_id")
    same = lambda table, batch_rows, *cols: sorted(map(tuple, assembly.table(spark, folder, table).select("dataset", batch, *cols).collect())) == sorted(map(tuple, batch_rows.select(*BATCH, *cols).collect()))
    report = drift.report(rows, final)
    rated = risk.mode_a(risk.summary(rows, final), config(spark), risk.uncertainty(renames))
    assert same("drift", final.fillna("-"), "kind", "column") and same("risk", rated, "risk", "level", "suggested_route")
    assert same("events", report, "drift_types", "n_add", "n_remove", "columns", "summary")
    assert {(r["batch_id"], r["flush_no"]): (r["drift_types"], r["route"], r["status"]) for r in assembly.table(spark, folder, "events").collect()} == {
        ("x", 0): ("", "production", "APPROVED"),
        ("x", 1): ("ADD,REMOVE,TYPE_CHANGE", "staging", "PENDING"),
        ("y", 0): ("REMOVE", "staging", "PENDING"),
    }
    assert same("events", registry.schema_hash(facts).withColumnRenamed("schema_hash", "schema_hash_observed"), "schema_hash_observed")
    placed = assembly.table(spark, folder, "routed").groupBy("batch_id", "flush_no", "place").count().collect()
    assert sorted(map(tuple, placed)) == [("x", 0, "production", 5), ("x", 1, "staging", 3), ("y", 0, "staging", 4)]
    lines = [json.loads(r["line"]) for r in assembly.table(spark, folder, "audit").collect()]
    assert {x["event_id"] for x in lines} == {r["event_id"] for r in assembly.table(spark, folder, "events").collect()} and len(lines) == 3
    versions = {r["schema_hash"]: r["version"] for r in assembly.table(spark, folder, "candidates").collect()}
    assert sorted(versions.values()) == [2, 3] and {x.get("schema_version_candidate") for x in lines} == {None, 2, 3}


def test_epochs_that_are_not_whole_are_not_seen(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/events/epoch=0")
    assert assembly.table(spark, str(tmp_path), "events") is None
    spark.range(1).write.parquet(f"{tmp_path}/commits/epoch=1")
    assert assembly.table(spark, str(tmp_path), "events").count() == 0


def test_rows_are_numbered_by_their_order_however_they_came(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put("1", *(row("x", a=i) | {"seq": i} for i in (5, 2, 9, 4)), row("y", a=1), row("y", a=2))
    feed.put("2", row("x", a=7) | {"seq": 7}, end("x") | {"seq": 8}, end("y"))
    feed.run()
    t = spark.read.schema(assembly.FLUSHED).parquet(f"{tmp_path}/out")
    got = sorted((r["batch_id"], r["row_no"], json.loads(r["payload"])["a"]) for r in t.collect())
    assert [g for g in got if g[0] == "x"] == [("x", i, str(i)) for i in (2, 4, 5, 7)]  # 9 is still open
    assert [n for b, n, _ in got if b == "y"] == [0, 1]


def test_flush_events_equal_sql_with_rows_in_another_order(spark, tmp_path):
    """A rename near its threshold hangs on which values of a batch come first."""
    import duckdb

    from tabwarden.plans import catalog

    own = tmp_path / "customer.parquet"
    rows = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM '/root/testdata/sf0.1/customer.parquet' WHERE c_nationkey < 5 ORDER BY hash(c_custkey)"
    c = duckdb.connect()
    c.sql(f"COPY ({rows}) TO '{own}' (FORMAT parquet)")
    c.sql(f"CREATE VIEW customer AS SELECT * FROM '{own}'")
    cols = ("dataset", "batch_id", "flush_no", "drift_types", "n_rows", "status")
    got = catalog.QUERIES["stream_flush_events"](spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE_SQL['stream_flush_events']})").fetchall())
