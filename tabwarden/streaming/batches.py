"""Message streams: parsing, batch assembly, routing and replay, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.operators.events import payload_type
from tabwarden.operators.text import run_plan

MESSAGE = "dataset string, batch_id string, type string, payload map<string,string>, seq long"


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value) -> (rows and end marks, quarantined values)."""
    m = F.from_json("value", MESSAGE)
    read = messages.select("value", m.alias("m"))
    good = F.col("m").isNotNull() & F.col("m.dataset").isNotNull() & F.col("m.batch_id").isNotNull()
    return read.where(good).select("m.*"), read.where(~F.coalesce(good, F.lit(False))).select("value")


def assembled(rows: DataFrame) -> DataFrame:
    """(dataset, batch_id, n_rows, complete): batches with their rows counted; complete once the end mark is there."""
    is_end = F.coalesce(F.col("type") == "end_batch", F.lit(False))
    return rows.groupBy("dataset", "batch_id").agg(F.count_if(~is_end).alias("n_rows"), F.max(is_end).alias("complete"))


def idle_batches(rows: DataFrame, gap: str = "8 seconds", late: str = "1 minute") -> DataFrame:
    """rows (dataset, batch_id, ts) of a stream: a batch ends when nothing came for `gap`; later rows form another."""
    return rows.withWatermark("ts", late).groupBy("dataset", "batch_id", F.session_window("ts", gap)).agg(F.count("*").alias("n_rows"))


def on_each(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run batch operators on every micro-batch; `handle` must be idempotent on the epoch it is given."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def route(raw: DataFrame) -> DataFrame:
    """(value) -> (topic, value); what has no known type is dropped."""
    kind = payload_type(F.col("value"))
    return raw.select(F.concat(F.lit("detected_"), kind).alias("topic"), "value").where(kind != "unknown")


def replay(rows: DataFrame) -> DataFrame:
    """A stored table as messages, with an end mark for each batch."""
    keys = ("dataset", "batch_id")
    fields = [c for c in rows.columns if c not in keys]
    payload = F.create_map(*(x for c in fields for x in (F.lit(c), F.col(c).cast("string"))))
    body = rows.select(F.to_json(F.struct(*keys, payload.alias("payload"))).alias("value"))
    ends = rows.select(*keys).distinct().select(F.to_json(F.struct(*keys, F.lit("end_batch").alias("type"))).alias("value"))
    return body.unionByName(ends)


def flush(handle_rows: Callable[[DataFrame, str], None], known: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` handler that gives each complete batch of a micro-batch to `handle_rows`, once.

    known() gives the (dataset, batch_id, flush_no) handled before, so a micro-batch that is run again does
    nothing; rows that come after a batch's end are a further flush of it.
    """

    def run(rows: DataFrame, epoch: int) -> None:
        done = known()
        last = done.groupBy("dataset", "batch_id").agg(F.max("flush_no").alias("last"), F.max("epoch").alias("last_epoch"))
        ended = assembled(rows).where("complete").select("dataset", "batch_id").join(last, ["dataset", "batch_id"], "left")
        fresh = ended.where(f"last_epoch IS NULL OR last_epoch < {epoch}").withColumn("flush_no", F.coalesce("last", F.lit(-1)) + 1)
        body = rows.where("coalesce(type, '') <> 'end_batch'").join(fresh.select("dataset", "batch_id", "flush_no"), ["dataset", "batch_id"])
        handle_rows(body.withColumn("epoch", F.lit(epoch)), f"epoch {epoch}")

    return run


def clean_texts(messages: DataFrame) -> DataFrame:
    """A stream of texts (value) through the text steps -> (topic, value): JSON records with their status."""
    out = run_plan(messages.select(F.coalesce(F.get_json_object("value", "$.text"), "value").alias("text")), "text")
    return out.select(F.lit("processed_text").alias("topic"), F.to_json(F.struct("text", "clean_text", "sentences", "tokens", "steps", "errors", "status")).alias("value"))


def topic_sink(messages: DataFrame, checkpoint: str, format: str = "kafka", **options: str):
    """Writes (topic, value) to each row's topic; other formats take the same rows, as in tests."""
    out = messages.select("topic", F.col("value").cast("string").alias("value"))
    return out.writeStream.format(format).option("checkpointLocation", checkpoint).options(**options)


def replay_counts(rows: DataFrame) -> DataFrame:
    """(dataset, batch_id, sent): messages of each batch, its end mark included."""
    return rows.groupBy("dataset", "batch_id").agg((F.count("*") + 1).alias("sent"))


def newest_log(rows: DataFrame, n: int = 100) -> DataFrame:
    """The newest log rows, 1000 at most."""
    return rows.orderBy(F.desc("ts"), "value").limit(min(n, 1000))


def live_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("topic").agg(F.count("*").alias("n"))


def kafka_source(spark, servers: str, topics: list[str], group: str | None = None) -> DataFrame:
    """Needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    reader = reader.option("kafka.group.id", group) if group else reader
    return reader.option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value"))
