"""Batches put together from a stream of rows, and what follows each batch.

A batch is a (dataset, batch_id).  Its rows are held in keyed state until its end mark comes or nothing came
for a while; then they leave together as a flush.  Rows that come later are a further flush of it.  The state
is in the query's checkpoint, so a restart loses and repeats nothing.

`write_flushes` takes each epoch's flushes through drift, risk, routing and audit into tables with a partition
an epoch.  An epoch that is run again overwrites its own partitions; readers see the epochs that are whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tabwarden.functions.stored import stored
from tabwarden.operators import drift, matching, profile, registry, reports, risk
from tabwarden.operators.profile import BATCH

#: State that holds lists and timers needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FLUSHED = "dataset string, batch_id string, shard int, flush_no int, row_no long, payload string, closed string"
#: Rows that leave the state at once.
STEP = 10_000


class BatchAssembler(StatefulProcessor):
    """Holds (seq, row_no, payload) of a batch until it ends."""

    def __init__(self, silence_ms: int | None, forget_ms: int | None):
        self.silence_ms, self.forget_ms = silence_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "seq long, row_no long, payload string")
        # what outlives a flush: its number, and the rows numbered so far
        self.counts = handle.getValueState("counts", "flush_no int, next_row long, held long", self.forget_ms)

    def _timer(self, at: int | None) -> None:
        if self.silence_ms is None:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def _out(self, key: Any, some: list[tuple[int, int, str]], closed: str) -> pd.DataFrame:
        flush, number, payload = zip(*some, strict=True)
        return pd.DataFrame({"dataset": key[0], "batch_id": key[1], "shard": key[2], "flush_no": pd.array(flush, dtype="int32"), "row_no": number, "payload": payload, "closed": closed}).astype({"shard": "int32"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        flush_no, next_row, held = self.counts.get() or (0, 0, 0)
        ends: list[int] = []
        for chunk in rows:
            is_end = chunk["is_end"].to_numpy(dtype=bool)
            ends += chunk["seq"][is_end].tolist()
            body = chunk[~is_end]
            if len(body):
                self.rows.appendList([(int(s), int(s) if own else next_row + i, p) for i, (s, own, p) in enumerate(zip(body["seq"], body["ordered"], body["payload"], strict=True))])
                next_row, held = next_row + len(body), held + len(body)
        ends = sorted(set(ends))
        if ends and held:
            # an end mark without rows before it ends nothing
            filled = sorted({i for s, _, _ in self.rows.get() if (i := bisect_left(ends, s)) < len(ends)})
            number = {i: flush_no + k for k, i in enumerate(filled)}
            some: list[tuple[int, int, str]] = []
            stay: list[tuple[int, int, str]] = []
            for s, n, p in self.rows.get():
                i = bisect_left(ends, s)
                if i >= len(ends):
                    stay.append((s, n, p))
                    continue
                some.append((number[i], n, p))
                if len(some) >= STEP:
                    yield self._out(key, some, "end")
                    some = []
            if some:
                yield self._out(key, some, "end")
            self.rows.clear()
            if stay:
                self.rows.put(stay)
            flush_no, held = flush_no + len(filled), len(stay)
        self.counts.update((flush_no, next_row, held))
        self._timer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms if held and self.silence_ms is not None else None)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        flush_no, next_row, held = self.counts.get() or (0, 0, 0)
        some: list[tuple[int, int, str]] = []
        if held:
            for _, n, p in self.rows.get():
                some.append((flush_no, n, p))
                if len(some) >= STEP:
                    yield self._out(key, some, "silence")
                    some = []
            if some:
                yield self._out(key, some, "silence")
            self.rows.clear()
            self.counts.update((flush_no + 1, next_row, 0))


def assemble(messages: DataFrame, silence_seconds: float | None = 8.0, shards: int = 1, forget_days: float | None = 30.0) -> DataFrame:
    """A stream of (dataset, batch_id, type, payload map, and seq where messages have an order) -> FLUSHED, a row a row of an ended batch.

    A row belongs to the first end mark whose seq isn't smaller; without seq, end marks come after all rows of
    their micro-batch.  A row's number is its seq, without one its place among the batch's rows as they came to
    the state, which is another in each run.  Messages without a data set, a batch or, unless end marks, a payload are dropped, as is
    an end mark of no rows.  A batch whose rows are too many for one task is dealt to `shards` parts by its
    rows' contents; every part gets the end marks, and `silence` is then that of a part.  Flush numbers are
    kept for `forget_days` after a batch's last row.  Without `silence_seconds` only end marks end a batch and
    flush numbers are kept for good; a run over what is available then comes to an end, while with it the query
    waits for timers until it is stopped.
    """
    spark = messages.sparkSession
    spark.conf.set(*STORE)
    seq = F.col("seq").cast("long") if "seq" in messages.columns else F.lit(None).cast("long")
    is_end = F.coalesce(F.col("type") == "end_batch", F.lit(False))
    named = messages.where(F.coalesce(F.col("dataset") != "", F.lit(False)) & F.coalesce(F.col("batch_id") != "", F.lit(False)) & (is_end | F.col("payload").isNotNull()))
    body = F.to_json("payload")
    shard = F.when(is_end, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64(body), F.lit(shards)).cast("int")))
    rows = named.select("dataset", "batch_id", F.explode(shard).alias("shard"), is_end.alias("is_end"), F.coalesce(seq, F.lit(0)).cast("long").alias("seq"), seq.isNotNull().alias("ordered"), body.alias("payload"))
    keyed = rows.groupBy("dataset", "batch_id", "shard")
    if silence_seconds is None:
        return keyed.transformWithStateInPandas(BatchAssembler(None, None), FLUSHED, "append", "none")
    forget = None if forget_days is None else int(forget_days * 86_400_000)
    return keyed.transformWithStateInPandas(BatchAssembler(int(silence_seconds * 1000), forget), FLUSHED, "append", "processingTime")


# ---- what follows a flush ----

#: Tables of `write_flushes`: changes, risks, events, rows with their place, audit lines; besides them the rows as they came, candidates of schemas and whole epochs.
TABLES = ("drift", "risk", "events", "routed", "audit")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table's rows of whole epochs, None before the first."""
    whole, rows = _read(spark, f"{folder}/commits"), _read(spark, f"{folder}/{name}")
    return None if whole is None or rows is None else rows.join(F.broadcast(whole.select("epoch")), "epoch", "left_semi")  # a row an epoch


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing was written yet
        return None


def write_flushes(folder: str, canonical: Callable[[SparkSession], DataFrame], baseline: Callable[[SparkSession], DataFrame], config: Callable[[SparkSession], DataFrame], fields: Callable[[SparkSession], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` handler for FLUSHED rows: drift against the canonical schemas, renames, risk, an event, routed rows and an audit line for each flush.

    canonical (dataset, column, type, nullable), baseline as `profile.baseline` gives it, config as
    `risk.resolve_config`, fields as `risk.contributions` takes them.  Flushes of data sets without a canonical
    schema are kept in the table `unregistered`.  Writing is by epoch: a rerun overwrites what it wrote.
    """

    def put(df: DataFrame, name: str, epoch: int) -> DataFrame:
        path = f"{folder}/{name}/epoch={epoch}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def run(flushed: DataFrame, epoch: int) -> None:
        spark = flushed.sparkSession
        # first of all the rows, so that the stream's state is worked on once
        came = put(flushed.withColumn("payload", F.from_json("payload", "map<string,string>")), "flushed", epoch)
        if came.isEmpty():
            return
        known = canonical(spark)
        named = known.select("dataset").distinct()
        put(came.join(named, "dataset", "left_anti"), "unregistered", epoch)
        # a flush is a batch of its own
        unit = F.concat_ws("\u0001", "batch_id", "flush_no")
        rows = came.join(named, "dataset", "left_semi").select("dataset", unit.alias("batch_id"), "row_no", "payload")
        parts = lambda df: df.select("dataset", F.substring_index("batch_id", "\u0001", 1).alias("batch_id"), F.substring_index("batch_id", "\u0001", -1).cast("int").alias("flush_no"), *(c for c in df.columns if c not in BATCH))

        facts = stored(profile.column_facts(rows), "flush-facts")
        found = stored(drift.changes(known, facts), "flush-changes")
        scored = matching.candidates(found, baseline(spark), facts, profile.first_values(rows))
        renames = stored(matching.assign(scored), "flush-renames")
        final = stored(drift.with_renames(found, renames), "flush-final")
        put(parts(final), "drift", epoch)

        sizes = rows.groupBy(*BATCH).agg(F.count("*").alias("n_rows"))
        settings = config(spark)
        a = risk.mode_a(risk.summary(sizes, final), settings, risk.uncertainty(renames)).select(*BATCH, "risk", "level", "suggested_route")
        own = fields(spark) if fields else spark.createDataFrame([], "dataset string, column string, field_criticality string, semantic_type string, allow_remove string, allow_type_change string, allow_nullable_change string, allow_rename string")
        b = risk.mode_b(sizes, risk.contributions(final, renames, settings, own)).select(*BATCH, "risk", "level", "suggested_route")
        mode = settings.select("dataset", "mode")
        rated = a.join(mode, "dataset", "left").where("coalesce(mode, 'A') = 'A'").unionByName(b.join(mode, "dataset").where("mode = 'B'").select(*BATCH, "risk", "level", "suggested_route", "mode"))
        rated = rated.withColumn("mode", F.coalesce("mode", F.lit("A")))
        rated = stored(rated, "flush-risk")
        put(parts(rated), "risk", epoch)

        observed = registry.schema_hash(facts)
        active = registry.schema_hash(known, ("dataset",)).withColumnRenamed("schema_hash", "schema_hash_active")
        before = registry.canonical_versions(active.withColumnRenamed("schema_hash_active", "schema_hash"))
        earlier = table(spark, folder, "candidates")
        if earlier is not None:
            before = before.unionByName(earlier.where(F.col("epoch") < epoch).select(*before.columns))
        versions = stored(registry.with_candidates(before, observed), "flush-versions")
        put(versions.join(before, ["dataset", "schema_hash"], "left_anti").select(*versions.columns), "candidates", epoch)

        report = drift.report(sizes, final)
        about = reports.batch_summary(facts, reports.explanations(final, renames)).select(*BATCH, F.col("summary").alias("explained"))
        suggested = report.join(rated, list(BATCH))
        routed = registry.route(suggested, F.col("suggested_route")).join(sizes, list(BATCH)).join(about, list(BATCH), "left").join(observed, list(BATCH), "left").join(active, "dataset", "left")
        candidate = versions.where("status <> 'active'").groupBy("dataset", "schema_hash").agg(F.max("version").alias("schema_version_candidate"))
        events = parts(routed.join(candidate, ["dataset", "schema_hash"], "left")).withColumnRenamed("schema_hash", "schema_hash_observed")
        flush_key = F.concat_ws("\u0001", "dataset", "batch_id", F.col("flush_no").cast("string"))
        events = put(events.withColumn("event_id", F.substring(F.sha2(flush_key, 256), 1, 16)), "events", epoch)

        # a row goes where its flush goes
        placed = events.select("dataset", "batch_id", "flush_no", F.col("route").alias("place"), "status")
        put(came.join(placed, ["dataset", "batch_id", "flush_no"]), "routed", epoch)
        line = F.to_json(F.struct("event_id", "dataset", "batch_id", "flush_no", F.col("risk").alias("risk_score"), F.col("level").alias("risk_level"), F.col("suggested_route").alias("route_suggested"), F.col("route").alias("route_applied"), "status", "drift_types", "schema_hash_active", "schema_hash_observed", "schema_version_candidate", F.col("explained").alias("summary")))
        put(events.select("dataset", "batch_id", "flush_no", line.alias("line")), "audit", epoch)
        put(spark.range(1).select(F.lit(True).alias("whole")), "commits", epoch)

    return run
