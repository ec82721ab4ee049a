"""Audit logs: JSON lines with fields of several names, as tables of fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.normalise import to_timestamp

# The columns of an audit table with the names that a line may give them.
COLUMNS = (
    ("ts", ("ts", "created_at", "timestamp")), ("dataset", ("dataset", "dataset_name")), ("event_id", ("event_id", "id")), ("batch_id", ("batch_id", "batch")), ("action", ("action",)),
    ("approver", ("approver", "decision_by", "user")), ("status", ("status",)), ("drift_types", ("drift_types",)), ("risk_score", ("risk_score",)), ("risk_level", ("risk_level",)), ("route_suggested", ("route_suggested",)),
    ("route_applied", ("route_applied",)), ("note", ("note",)), ("reason", ("reason",)), ("summary", ("summary",)), ("schema_version_candidate", ("schema_version_candidate",)), ("schema_hash_active", ("schema_hash_active",)),
    ("schema_hash_observed", ("schema_hash_observed",)), ("activated_schema_version", ("activated_schema_version",)), ("promoted_rows", ("promoted_rows",)), ("moved_rows", ("moved_rows",)),
)
_DIFF = "added array<string>, removed array<string>, type_changes array<struct<column:string,`from`:string,`to`:string>>, nullable_changes array<struct<column:string>>"


def fields(line: Column) -> Column:
    """A line's fields as text; a line that isn't a JSON object is its field `raw`."""
    parsed = F.when(F.trim(line).startswith("{"), F.from_json(line, "map<string,string>"))
    return F.coalesce(parsed, F.create_map(F.lit("raw"), line))


def _any(m: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_element_at(m, F.lit(n)) for n in names), F.lit(""))


def _csv(c: Column) -> Column:
    """A JSON list as comma-joined text; other text as it is."""
    return F.when(c.startswith("["), F.array_join(F.from_json(c, "array<string>"), ",")).otherwise(c)


def read_events(lines: DataFrame, dataset: str | None = None) -> DataFrame:
    """lines (line) -> (line, f map, at timestamp): JSON objects only, of one data set whatever its case, if named."""
    names = dict(COLUMNS)
    rows = lines.where(F.trim("line").startswith("{")).select("line", F.from_json("line", "map<string,string>").alias("f")).where("f IS NOT NULL")
    rows = rows.withColumn("at", to_timestamp(_any(F.col("f"), ("created_at", "ts", "timestamp"))))
    if dataset is not None:
        rows = rows.where(F.lower(F.trim(_any(F.col("f"), names["dataset"]))) == dataset.strip().lower())
    return rows


def in_order(rows: DataFrame) -> DataFrame:
    """By time, those without one first."""
    return rows.orderBy(F.asc_nulls_first("at"), "line")


def audit_table(lines: DataFrame, dataset: str | None = None) -> DataFrame:
    """lines (line) -> 22 columns of text, raw_json last; lines that aren't objects are kept there."""
    f = lines.where("trim(line) <> ''").select("line", fields(F.col("line")).alias("f"))
    out = f.select(*((_csv(_any(F.col("f"), names)) if c == "drift_types" else _any(F.col("f"), names)).alias(c) for c, names in COLUMNS), F.col("line").alias("raw_json"))
    return out if dataset is None else out.where(F.lower(F.trim("dataset")) == dataset.strip().lower())


def event_rows(lines: DataFrame) -> DataFrame:
    """A row an event: counts and joined names of each kind of change; drift types are taken from the changes where they aren't given."""
    f, d = F.col("f"), F.col("d")
    rows = read_events(lines).withColumn("d", F.from_json(_any(f, ("diff",)), _DIFF)).withColumn("m", F.from_json(F.get_json_object(_any(f, ("renames",)), "$.mappings"), "map<string,string>"))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    added, removed, retyped, nulls, renamed = n(d["added"]), n(d["removed"]), n(d["type_changes"]), n(d["nullable_changes"]), n(F.col("m"))
    given = _csv(_any(f, ("drift_types",)))
    inferred = F.array_join(F.array_compact(F.array(*(F.when(c > 0, F.lit(k)) for c, k in ((added, "ADD"), (removed, "REMOVE"), (retyped, "TYPE_CHANGE"), (nulls, "NULLABLE_CHANGE"), (renamed, "RENAME"))))), ",")
    text = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    pairs = F.coalesce(F.array_join(F.transform(F.sort_array(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("->"), e["value"])), "; "), F.lit(""))
    types = F.coalesce(F.array_join(F.transform(d["type_changes"], lambda x: F.concat(x["column"], F.lit(":"), x["from"], F.lit("->"), x["to"])), "; "), F.lit(""))
    names = dict(COLUMNS)
    return rows.select(
        _any(f, names["event_id"]).alias("event_id"), _any(f, names["dataset"]).alias("dataset"), _any(f, names["batch_id"]).alias("batch_id"), F.coalesce(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("created_at"),
        F.when(given != "", given).otherwise(inferred).alias("drift_types"), added.alias("added_count"), removed.alias("removed_count"), renamed.alias("rename_count"), retyped.alias("type_change_count"), nulls.alias("nullable_change_count"),
        text(d["added"]).alias("added_cols"), text(d["removed"]).alias("removed_cols"), pairs.alias("rename_pairs"), types.alias("type_changes"),
    )


def one_line(table: DataFrame) -> DataFrame:
    """An audit table with `label`, the action taken or detected, and a one-line `summary_line` of what is set."""
    part = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}="), F.col(c)))
    label = F.when(F.col("action") != "", F.upper("action")).when(F.col("drift_types") != "", "DRIFT").otherwise("EVENT")
    line = F.concat_ws(" | ", part("batch", "batch_id"), part("drift", "drift_types"), part("risk", "risk_score"), part("level", "risk_level"), part("route", "route_applied"), part("by", "approver"), part("reason", "reason"))
    return table.withColumn("label", label).withColumn("summary_line", line)


def counters(records: DataFrame) -> DataFrame:
    """records (kind, agent, seconds): one row of totals by kind, number of agents seen, mean time."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_processed")
    return records.agg(F.count("*").alias("total"), n("text"), n("image"), F.count_distinct("agent").alias("active_agents"), F.round(F.avg("seconds"), 6).alias("avg_seconds"))
