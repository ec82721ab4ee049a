"""Queries that send stored batches through a stream and read the tables that it writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.functions.stored import shared_folder
from tabwarden.operators.drift import ORDER
from tabwarden.plans import matching
from tabwarden.plans.register import Registry
from tabwarden.streaming import assembly, batches

R = Registry()

_KINDS = f"""{matching._ASSIGNED}, kinds AS (SELECT dataset, batch_id, list(DISTINCT kind) AS ks FROM final GROUP BY ALL), sized AS (SELECT dataset, batch_id, count(*) AS n_rows FROM t GROUP BY ALL),
ev AS (SELECT s.dataset, s.batch_id, n_rows, ks FROM sized s LEFT JOIN kinds k ON k.dataset = s.dataset AND k.batch_id = s.batch_id)"""


def flush_tables(spark: SparkSession, sf_dir: str) -> str:
    """The customers' batches as messages through assembly and what follows it; the folder of the tables."""
    folder = f"{shared_folder(spark)}/flushes-{uuid.uuid4().hex}"
    rows = matching.batches(spark, sf_dir)
    # rows go in the order of their keys, so that a batch's first examples are the same however its files are cut
    body = rows.select(F.to_json(F.struct("dataset", "batch_id", "payload", F.col("row_no").alias("seq"))).alias("value"))
    last = rows.groupBy("dataset", "batch_id").agg(F.greatest(F.max("row_no"), F.lit(0)).alias("seq"))
    ends = last.select(F.to_json(F.struct("dataset", "batch_id", F.lit("end_batch").alias("type"), "seq")).alias("value"))
    body.unionByName(ends).write.mode("append").text(f"{folder}/messages")
    facts = matching._facts(spark, sf_dir)
    baseline = matching._baseline(spark, sf_dir, facts)
    handle = assembly.write_flushes(f"{folder}/tables", lambda s: matching._canonical(s, facts), lambda s: baseline, matching._config)
    stream = spark.readStream.format("text").load(f"{folder}/messages")
    held = assembly.assemble(batches.parse(stream)[0], silence_seconds=None)
    held.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/tables"


@R.query(f"""WITH RECURSIVE {_KINDS} SELECT dataset, batch_id, CAST(0 AS INTEGER) AS flush_no, array_to_string(list_filter({list(ORDER)}, lambda x: list_contains(coalesce(ks, []), x)), ',') AS drift_types, n_rows, CASE WHEN ks IS NULL THEN 'APPROVED' ELSE 'PENDING' END AS status FROM ev""")
def stream_flush_events(spark, sf_dir) -> DataFrame:
    events = assembly.table(spark, flush_tables(spark, sf_dir), "events")
    return events.select("dataset", "batch_id", "flush_no", "drift_types", "n_rows", "status")


@R.query(f"""WITH RECURSIVE {_KINDS} SELECT t.dataset, t.batch_id, c_name AS name, CASE WHEN ks IS NULL THEN 'production' ELSE 'staging' END AS place FROM t JOIN ev ON ev.dataset = t.dataset AND ev.batch_id = t.batch_id""")
def stream_routed_rows(spark, sf_dir) -> DataFrame:
    """Where each customer's row went, after its batch was put together."""
    routed = assembly.table(spark, flush_tables(spark, sf_dir), "routed")
    return routed.select("dataset", "batch_id", F.coalesce(F.col("payload")["c_name"], F.col("payload")["fullName"]).alias("name"), "place")
