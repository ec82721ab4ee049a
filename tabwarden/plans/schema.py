"""Queries of profiling, drift, matching, risk, registry and event operators, with their SQL.

Batches are derived from events: a day is a batch whose rows carry other fields from day to day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.functions import normalise as N
from tabwarden.functions.stored import stored
from tabwarden.operators import drift, events, matching, profile, registry
from tabwarden.plans.register import Registry, table

R = Registry()


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts"))
    kind = F.col("day") % 5
    value = F.format_string("%.2f", "value")
    payload = F.map_concat(
        F.create_map(F.lit("User ID"), F.col("user_id").cast("string"), F.lit("event_type"), F.when(F.col("event_id") % 10 != 3, F.col("event_type"))),
        F.when(kind == 1, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).when(kind == 2, F.create_map(F.lit("Value USD"), value)).when(kind == 4, F.create_map(F.lit("value"), F.floor("value").cast("string"))).otherwise(F.create_map(F.lit("value"), value)),
        F.when(kind == 3, F.create_map(F.lit("props"), F.col("props"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
    )
    return t.select(F.lit("events").alias("dataset"), F.format_string("d%02d", "day").alias("batch_id"), F.col("event_id").alias("row_no"), payload.alias("payload"))


_CELLS = """t AS (SELECT *, day(ts) % 5 AS k, format('d{:02d}', day(ts)) AS batch_id FROM events), raw AS (
 SELECT batch_id, 'user_id' AS "column", CAST(user_id AS VARCHAR) AS value FROM t UNION ALL SELECT batch_id, 'event_type', CASE WHEN event_id % 10 <> 3 THEN event_type END FROM t
 UNION ALL SELECT batch_id, CASE WHEN k = 2 THEN 'value_usd' ELSE 'value' END, CASE WHEN k = 4 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', value) END FROM t WHERE k <> 1
 UNION ALL SELECT batch_id, 'props', props FROM t WHERE k = 3),
rows_ AS (SELECT batch_id, count(*) AS n_rows FROM t GROUP BY 1),
num AS (SELECT *, CASE WHEN NOT regexp_matches(value, '[A-Za-z:]') THEN TRY_CAST(value AS DOUBLE) END AS x FROM raw),
sums AS (SELECT batch_id, "column", count(value) AS n, count(x) AS nx, count(*) FILTER (x = floor(x)) AS nw, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max FROM num GROUP BY ALL),
facts AS (SELECT 'events' AS dataset, batch_id, "column", true AS present, round(1 - n / n_rows, 6) AS null_rate,
 CASE WHEN nx / n_rows > 0.8 AND nw / nx > 0.95 THEN 'int' WHEN nx / n_rows > 0.8 THEN 'float' ELSE 'string' END AS type, n < n_rows AS nullable, nx / n_rows > 0.8 AS numeric, mean, std, min, max FROM sums JOIN rows_ USING (batch_id))"""


@R.query(f"""WITH {_CELLS} SELECT dataset, batch_id, "column", present, null_rate, type, nullable, CASE WHEN numeric THEN round(mean, 6) END AS mean, CASE WHEN numeric THEN round(std, 6) END AS std,
 CASE WHEN numeric THEN round(min, 6) END AS min, CASE WHEN numeric THEN round(max, 6) END AS max FROM facts""")
def column_profile(spark, sf_dir):
    return profile.column_facts(batches(spark, sf_dir))


@R.query(f"""WITH {_CELLS}, c AS (SELECT batch_id, "column", trim(value) AS v, count(*) AS n FROM raw WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, "column" ORDER BY n DESC, v) AS k FROM c)
SELECT 'events' AS dataset, batch_id, "column", string_agg(v, '|' ORDER BY k) AS examples FROM r WHERE k <= 8 GROUP BY batch_id, "column" """)
def baseline_profile(spark, sf_dir):
    return profile.frequent_values(batches(spark, sf_dir))


CANONICAL = (("events", "user_id", "int", False), ("events", "event_type", "string", False), ("events", "value", "float", False))
_CANON = "canon(c, ct, cn) AS (VALUES ('user_id', 'int', false), ('event_type', 'string', false), ('value', 'float', false))"


def canonical(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANONICAL, "dataset string, column string, type string, nullable boolean")


_CHANGES = f"""{_CELLS}, {_CANON}, b AS (SELECT DISTINCT batch_id FROM facts), w AS (SELECT * FROM b, canon), j AS (SELECT coalesce(w.batch_id, f.batch_id) AS batch_id, coalesce(c, "column") AS "column", ct, cn, type, nullable FROM w FULL JOIN facts f ON w.batch_id = f.batch_id AND c = "column"),
changes AS (SELECT 'events' AS dataset, batch_id, 'ADD' AS kind, "column", CAST(NULL AS VARCHAR) AS old, type AS new FROM j WHERE ct IS NULL UNION ALL SELECT 'events', batch_id, 'REMOVE', "column", ct, NULL FROM j WHERE type IS NULL
 UNION ALL SELECT 'events', batch_id, 'TYPE_CHANGE', "column", ct, type FROM j WHERE ct <> type UNION ALL SELECT 'events', batch_id, 'NULLABLE_CHANGE', "column", 'false', 'true' FROM j WHERE NOT cn AND nullable)"""


def _changes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Changes and facts, each a small written table: one scan of the rows."""
    facts = stored(profile.column_facts(batches(spark, sf_dir)), "facts")
    return stored(drift.changes(canonical(spark), facts), "changes"), facts


@R.query(f"WITH {_CHANGES} SELECT * FROM changes")
def drift_changes(spark, sf_dir):
    return _changes(spark, sf_dir)[0]


_REN = """ren AS (SELECT r.batch_id, r."column" AS old_name, a."column" AS new_name FROM changes r JOIN changes a ON r.batch_id = a.batch_id AND r.kind = 'REMOVE' AND a.kind = 'ADD' WHERE r."column" = 'value' AND a."column" = 'value_usd'),
final AS (SELECT batch_id, kind, "column" FROM changes c WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.batch_id = c.batch_id AND ((c.kind = 'REMOVE' AND c."column" = old_name) OR (c.kind = 'ADD' AND c."column" = new_name)))
 UNION ALL SELECT batch_id, 'RENAME', old_name FROM ren),
sums2 AS (SELECT batch_id, count(*) FILTER (kind = 'ADD') AS n_add, count(*) FILTER (kind = 'REMOVE') AS n_remove, count(*) FILTER (kind = 'TYPE_CHANGE') AS n_type_change, count(*) FILTER (kind = 'NULLABLE_CHANGE') AS n_nullable_change,
 count(*) FILTER (kind = 'RENAME') AS n_rename, string_agg(DISTINCT "column", ',' ORDER BY "column") AS columns FROM final GROUP BY 1),
rep AS (SELECT 'events' AS dataset, batch_id, concat_ws(',', CASE WHEN n_add > 0 THEN 'ADD' END, CASE WHEN n_remove > 0 THEN 'REMOVE' END, CASE WHEN n_type_change > 0 THEN 'TYPE_CHANGE' END, CASE WHEN n_nullable_change > 0 THEN 'NULLABLE_CHANGE' END, CASE WHEN n_rename > 0 THEN 'RENAME' END) AS drift_types,
 coalesce(n_add, 0) AS n_add, coalesce(n_remove, 0) AS n_remove, coalesce(n_type_change, 0) AS n_type_change, coalesce(n_nullable_change, 0) AS n_nullable_change, coalesce(n_rename, 0) AS n_rename, coalesce(columns, '') AS columns FROM b LEFT JOIN sums2 USING (batch_id))"""


def _report(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    found, facts = _changes(spark, sf_dir)
    first = F.col("batch_id") == "d05"  # a day with all columns is the baseline
    rows = batches(spark, sf_dir)
    known = profile.baseline(canonical(spark), facts.where(first), profile.frequent_values(rows.where(first), as_array=True))
    renames = stored(matching.assign(matching.candidates(found, known, facts, profile.first_values(rows))), "renames")
    final = drift.with_renames(found, renames)
    return drift.report(facts, final), final, renames


@R.query(f"WITH {_CHANGES}, {_REN} SELECT *, CASE WHEN drift_types = '' THEN 'no drift' ELSE 'drift: ' || drift_types END AS summary FROM rep")
def drift_report(spark, sf_dir):
    return _report(spark, sf_dir)[0]


@R.query(f"WITH {_CHANGES}, {_REN} SELECT 'events' AS dataset, batch_id, old_name, new_name FROM ren")
def match_assign(spark, sf_dir):
    return _report(spark, sf_dir)[2].drop("confidence")


@R.query(f"""WITH {_CHANGES}, {_REN} SELECT dataset, batch_id, drift_types, CASE WHEN drift_types <> '' THEN 'staging' ELSE 'production' END AS route, CASE WHEN drift_types <> '' THEN 'PENDING' ELSE 'APPROVED' END AS status FROM rep""")
def route_batches(spark, sf_dir):
    return registry.route(_report(spark, sf_dir)[0], F.lit("production")).select("dataset", "batch_id", "drift_types", "route", "status")


@R.query(f"""WITH {_CELLS} SELECT dataset, batch_id, sha256('{{"columns":[' || string_agg('{{"name":"' || "column" || '","type":"' || type || '"}}', ',' ORDER BY "column", type) || ']}}') AS schema_hash FROM facts GROUP BY dataset, batch_id""")
def schema_hash(spark, sf_dir):
    return registry.schema_hash(profile.column_facts(batches(spark, sf_dir)))


@R.query(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase, round(avg(value / 1000), 6) AS avg_risk, round(max(value / 1000), 6) AS max_risk,
 CASE max(CASE WHEN value >= 100 THEN 3 WHEN value >= 30 THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS max_level FROM events GROUP BY 1"""
)
def event_daily_summary(spark, sf_dir):
    return events.daily_summary(_events(spark, sf_dir), ("error", "purchase"))


def _events(spark, sf_dir) -> DataFrame:
    level = F.when(F.col("value") >= 100, "HIGH").when(F.col("value") >= 30, "MEDIUM").otherwise("LOW")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("kind"), (F.col("value") / 1000).alias("risk"), level.alias("level"), "props")


@R.query("SELECT count(*) AS total, count(*) FILTER (value >= 100) AS high, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events")
def kpis(spark, sf_dir):
    return events.kpis(_events(spark, sf_dir))


@R.query("SELECT event_id, event_type AS kind, user_id FROM events WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id LIMIT 100")
def event_list(spark, sf_dir):
    return events.newest(_events(spark, sf_dir).where(F.col("kind").isin("error", "purchase")), 100).select("event_id", "kind", "user_id")


@R.query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, s AS flush_no, n FROM (SELECT user_id, CAST(s AS BIGINT) AS s, count(*) AS n FROM s GROUP BY ALL)"""
)
def batch_sessions(spark, sf_dir):
    """Batches per user that an idle gap ends."""
    return events.sessions(_events(spark, sf_dir), "user_id", "INTERVAL 8 HOURS")


@R.query("SELECT CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'image' WHEN 'purchase' THEN 'audio' WHEN 'signup' THEN 'video' ELSE 'unknown' END AS topic, count(*) AS n FROM events GROUP BY 1")
def router_counts(spark, sf_dir):
    key = F.create_map(*(F.lit(x) for x in ("view", "text", "click", "image", "purchase", "audio", "signup", "video")))
    payload = table(spark, sf_dir, "events").select(F.coalesce(F.concat(F.lit('{"'), key[F.col("event_type")], F.lit('":"x"}')), F.lit('{"z":1}')).alias("value"))
    return payload.select(events.payload_type(F.col("value")).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@R.query(
    """SELECT DISTINCT trim(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '_') AS norm, regexp_replace(p_brand || '!x', '[^a-zA-Z0-9_\\-]+', '_', 'g') AS safe FROM part"""
)
def norm_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(N.norm_name(F.concat("p_name", F.lit(" / "), "p_brand")).alias("norm"), N.safe_name(F.concat("p_brand", F.lit("!x"))).alias("safe")).distinct()


@R.query(
    """SELECT p_brand, p_type, CASE WHEN k = 1 THEN p_type ELSE p_type || '_' || (k - 1) END AS unique_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part)"""
)
def unique_names(spark, sf_dir):
    return N.unique_names(table(spark, sf_dir, "part"), "p_type", "p_partkey", ("p_brand",)).select("p_brand", "p_type", "unique_name", "p_partkey")


@R.query(
    """SELECT c_custkey, round(c_acctbal, 2) AS parsed, CASE WHEN c_custkey % 2 = 0 AND c_acctbal >= 0 THEN -round(c_acctbal, 2) END AS negative, c_custkey % 3 = 0 AS flag, CAST(NULL AS DOUBLE) AS name_is_none FROM customer"""
)
def parse_values(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    money = F.concat(F.lit("$"), F.format_number("c_acctbal", 2))
    negative = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("("), F.format_number("c_acctbal", 2), F.lit(")")))
    flag = F.when(F.col("c_custkey") % 3 == 0, " Yes").otherwise("no")
    return t.select("c_custkey", N.to_double(money).alias("parsed"), N.to_double(negative).alias("negative"), N.to_bool(flag).alias("flag"), N.to_double(F.col("c_name")).alias("name_is_none"))


@R.query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000000Z') AS iso, CAST(round_even(o_totalprice, 0) AS BIGINT) AS whole FROM orders")
def iso_and_rounding(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    parsed = N.to_timestamp(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return t.select("o_orderkey", N.utc_iso(parsed).alias("iso"), N.cast_to_rule(F.col("o_totalprice"), "integer").cast("long").alias("whole"))


@R.query("SELECT c_custkey, c_name AS full_name, c_acctbal AS balance, to_json({'mktsegment': c_mktsegment, 'nationkey': CAST(c_nationkey AS VARCHAR)}) AS extras FROM customer")
def canonicalize_rows(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    payload = F.create_map(F.lit("Full Name"), F.col("c_name"), F.lit("acct-balance"), F.col("c_acctbal").cast("string"), F.lit("MktSegment"), F.col("c_mktsegment"), F.lit("NationKey"), F.col("c_nationkey").cast("string"))
    packed = registry.pack(t.select("c_custkey", payload.alias("payload")), {"full_name": "string", "balance": "double"}, {"acct_balance": "balance"})
    return packed.select("c_custkey", "canonical.*", F.to_json(F.struct(F.col("extras")["mktsegment"].alias("mktsegment"), F.col("extras")["nationkey"].alias("nationkey"))).alias("extras"))
