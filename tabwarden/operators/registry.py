"""Schema registry, routing and governance as append-only tables with a derived current state.

Decisions (dataset, batch_id, decision, actor, reason, at) are never changed; the latest of a batch counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions.normalise import norm_name
from tabwarden.operators.profile import BATCH


def schema_hash(facts: DataFrame, keys: tuple[str, ...] = BATCH) -> DataFrame:
    """(keys, schema_hash): sha256 of the sorted names and types, whatever the column order."""
    columns = F.sort_array(F.collect_list(F.struct(F.col("column").alias("name"), F.lower("type").alias("type"))))
    return facts.groupBy(*keys).agg(F.sha2(F.to_json(F.struct(columns.alias("columns"))), 256).alias("schema_hash"))


def canonical_versions(hashes: DataFrame) -> DataFrame:
    """hashes (dataset, schema_hash) of canonical schemas -> a registry in which each is version 1 and active."""
    return hashes.select("dataset", "schema_hash", F.lit(None).cast("string").alias("first_batch"), F.lit(1).cast("long").alias("version"), F.lit("active").alias("status"))


def with_candidates(registry: DataFrame, hashes: DataFrame) -> DataFrame:
    """The registry with hashes that it lacks as candidates of the next versions, in the order of first batches; none becomes active."""
    fresh = hashes.groupBy("dataset", "schema_hash").agg(F.min("batch_id").alias("first_batch")).join(registry, ["dataset", "schema_hash"], "left_anti")
    fresh = fresh.join(registry.groupBy("dataset").agg(F.max("version").alias("last")), "dataset", "left")
    number = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("dataset").orderBy("first_batch", "schema_hash"))  # versions, not rows
    new = fresh.select("dataset", "schema_hash", "first_batch", number.cast("long").alias("version"), F.lit("candidate").alias("status"))
    return registry.select(*new.columns).unionByName(new)


def latest(decisions: DataFrame) -> DataFrame:
    """The last decision of each batch."""
    rest = [c for c in decisions.columns if c not in BATCH]
    return decisions.groupBy(*BATCH).agg(F.max_by(F.struct(*rest), F.struct("at", "decision")).alias("d")).select(*BATCH, "d.*")


def activated(registry: DataFrame, hashes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Statuses after decisions: of a data set, the schema approved last, or rolled back to, is active, alone; others approved before are retired.

    hashes (dataset, batch_id, schema_hash, active_hash): the schema a batch came with and the one active then.
    """
    acts = latest(decisions).where("decision IN ('approve', 'rollback')").join(hashes, list(BATCH))
    wanted = acts.withColumn("wanted", F.when(F.col("decision") == "rollback", F.col("active_hash")).otherwise(F.col("schema_hash")))
    last = wanted.groupBy("dataset").agg(F.max_by("wanted", F.struct("at", "batch_id")).alias("wanted"))
    once = wanted.select("dataset", F.col("wanted").alias("schema_hash"), F.lit(True).alias("was")).distinct()
    j = registry.join(last, "dataset", "left").join(once, ["dataset", "schema_hash"], "left")
    status = F.when(F.col("wanted").isNull(), F.col("status")).when(F.col("schema_hash") == F.col("wanted"), "active").when((F.col("status") == "active") | F.col("was"), "retired").otherwise(F.col("status"))
    return j.select("dataset", "schema_hash", "first_batch", "version", status.alias("status"))


def active(registry: DataFrame) -> DataFrame:
    return registry.where("status = 'active'").select("dataset", "version", "schema_hash")


def newest_version(registry: DataFrame) -> DataFrame:
    """(dataset, schema_hash, version): the latest version of each hash."""
    return registry.groupBy("dataset", "schema_hash").agg(F.max("version").alias("version"))


def listed(registry: DataFrame) -> DataFrame:
    return registry.orderBy("dataset", F.desc("version"))


def route(reported: DataFrame, suggested: Column) -> DataFrame:
    """Any drift goes to staging and waits; else the suggested route is taken."""
    drifted = F.col("drift_types") != ""
    return reported.withColumn("route", F.when(drifted, "staging").otherwise(suggested)).withColumn("status", F.when(drifted, "PENDING").otherwise("APPROVED"))


def apply_decisions(staged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Staged rows with `place` and `status`: approved or rolled-back batches to production, rejected ones, with reason and actor, to rejected; others stay."""
    j = staged.join(latest(decisions).select(*BATCH, "decision", "actor", "reason"), list(BATCH), "left")
    up = F.col("decision").isin("approve", "rollback")
    place = F.when(up, "production").when(F.col("decision") == "reject", "rejected").otherwise("staging")
    status = F.when(up, "PROMOTED").when(F.col("decision") == "reject", "REJECTED").otherwise("PENDING")
    return j.select(*staged.columns, place.alias("place"), status.alias("status"), F.col("actor").alias("decided_by"), F.when(F.col("decision") == "reject", F.col("reason")).alias("reject_reason"))


def rollback(rows: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """Rows in an older schema: added columns go, missing ones are null."""
    return rows.select(*((F.col(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in schema))


def event_list(events: DataFrame, datasets: DataFrame, most: int = 200, **equal: str) -> DataFrame:
    """Events with their data set's name, newest first, at most `most` of 500; filters: status, route, actioned (`yes`: decided)."""
    out = events
    for field, value in equal.items():
        out = out.where(F.col("decided_at").isNotNull() == F.lit(value == "yes")) if field == "actioned" else out.where(F.upper(field) == value.upper())
    return out.join(datasets, "dataset", "left").orderBy(F.desc("ts"), "event_id").limit(min(most, 500))


def staging_queue(events: DataFrame, most: int = 200) -> DataFrame:
    return events.where("route = 'staging' AND status = 'PENDING'").orderBy(F.desc("ts"), "event_id").limit(min(most, 200))


def page(rows: DataFrame, order: str, offset: int, most: int) -> DataFrame:
    """Rows from `offset` on in the order of a unique key, with the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(order).offset(offset).limit(most).join(total)  # one row


def page_after(rows: DataFrame, order: str, after, most: int) -> DataFrame:
    """The `most` rows that follow a value of a unique key, None for the first: what is before it is filtered out and not sorted."""
    rest = rows if after is None else rows.where(F.col(order) > F.lit(after))
    return rest.orderBy(order).limit(most)


def kpis(events: DataFrame) -> DataFrame:
    n = lambda when, name: F.count_if(when).alias(name)
    c = F.col
    return events.agg(F.count("*").alias("total"), n(F.upper(c("level")) == "HIGH", "high"), n(c("status") == "PENDING", "pending"), n(c("route") == "staging", "staging"), n(c("status") == "PROMOTED", "promoted"))


def recent_actions(events: DataFrame, most: int = 6) -> DataFrame:
    return events.where("decided_at IS NOT NULL").orderBy(F.desc("decided_at"), "event_id").limit(most)


def alerts(rejected: DataFrame) -> DataFrame:
    """(dataset, batch_id, subject, body) for each rejected batch (dataset, batch_id, level, risk, actor, reason)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    subject = F.concat(F.lit("[rejected] "), "dataset", F.lit(" / "), "batch_id", F.lit(" ("), F.upper(text("level")), F.lit(")"))
    body = F.concat(F.lit("risk: "), text("risk"), F.lit("\nby: "), text("actor"), F.lit("\nreason: "), text("reason"))
    return rejected.select(*BATCH, subject.alias("subject"), body.alias("body"))


def pack(rows: DataFrame, canonical: dict[str, str], renames: dict[str, str] | None = None) -> DataFrame:
    """rows (..., payload map) -> (..., canonical struct, extras map, raw map, key_map): columns by their normalised names or renames."""
    named = F.transform_keys("payload", lambda k, v: norm_name(k))
    alias = {new: old for old, new in (renames or {}).items()}
    pick = lambda c: F.coalesce(F.col("_n")[c], F.col("_n")[alias[c]]) if c in alias else F.col("_n")[c]
    used = [*canonical, *alias.values()]
    out = rows.withColumn("_n", named)
    keys = F.map_from_arrays(F.map_keys("_n"), F.map_keys("payload"))
    return out.select(*(c for c in rows.columns if c != "payload"), F.struct(*(pick(c).try_cast(t).alias(c) for c, t in canonical.items())).alias("canonical"), F.map_filter("_n", lambda k, v: ~k.isin(*used)).alias("extras"), F.col("payload").alias("raw"), keys.alias("key_map"))


def unpacked(packed: Column, depth: int = 10) -> Column:
    """The row (map<string,string>) that a JSON text holds, from under up to `depth` packings: an object with `canonical` and `raw` is packed."""

    def inner(x: Column, _: Column) -> Column:
        raw = F.get_json_object(x, "$.raw")
        return F.when(F.get_json_object(x, "$.canonical").isNotNull() & raw.isNotNull(), raw).otherwise(x)

    return F.from_json(F.aggregate(F.sequence(F.lit(1), F.lit(depth)), packed, inner), "map<string,string>")


def best_canonical(packed: Column, columns: list[str]) -> Column:
    """Of a packed JSON text, its extras and its raw row, the canonical part of the first packed one in which a column isn't null, else the text's own."""

    def canonical(layer: Column) -> Column:
        return F.from_json(F.get_json_object(layer, "$.canonical"), "map<string,string>")

    layers = [packed, F.get_json_object(packed, "$.extras"), F.get_json_object(packed, "$.raw")]
    filled = [F.when(F.greatest(*(F.get_json_object(x, f"$.canonical.{c}").isNotNull() for c in columns)) if len(columns) > 1 else F.get_json_object(x, f"$.canonical.{columns[0]}").isNotNull(), canonical(x)) for x in layers]
    return F.coalesce(*filled, canonical(packed))
