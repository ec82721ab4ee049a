"""Queries of the registry, governance and audit operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.functions import normalise as N
from tabwarden.functions.stored import stored
from tabwarden.operators import audit, registry
from tabwarden.operators.profile import BATCH
from tabwarden.plans.matching import CANONICAL, _canonical, _FACTS, _facts, batches
from tabwarden.plans.register import Registry, table

R = Registry()

# decisions: of the nations' batches, by their number
_DECISIONS = """dec(dataset, batch_id, decision, actor, reason, made) AS (SELECT DISTINCT dataset, batch_id, 'approve', 'ann', NULL, 100 + c_nationkey FROM t WHERE c_nationkey % 7 = 1 UNION ALL SELECT DISTINCT dataset, batch_id, 'reject', 'bob', 'wrong file', 50 + c_nationkey FROM t WHERE c_nationkey % 7 IN (2, 3)
 UNION ALL SELECT DISTINCT dataset, batch_id, 'approve', 'eve', NULL, 150 + c_nationkey FROM t WHERE c_nationkey % 7 = 3 UNION ALL SELECT DISTINCT dataset, batch_id, 'rollback', 'ann', 'old schema', 10 + c_nationkey FROM t WHERE c_nationkey % 7 = 4), lat AS (SELECT * FROM dec QUALIFY row_number() OVER (PARTITION BY dataset, batch_id ORDER BY made DESC) = 1)"""
_HASH = lambda rows: f"""sha256('{{"columns":[' || string_agg('{{"name":"' || c || '","type":"' || y || '"}}', ',' ORDER BY c, y) || ']}}') AS schema_hash FROM {rows}"""
_REGISTRY = f"""{_FACTS}, {_DECISIONS}, hb AS (SELECT dataset, batch_id, {_HASH('(SELECT dataset, batch_id, "column" AS c, type AS y FROM facts)')} GROUP BY ALL), hc AS (SELECT {_HASH('(SELECT c, ct AS y FROM canon)')}),
fresh AS (SELECT dataset, schema_hash, min(batch_id) AS first_batch FROM hb WHERE schema_hash NOT IN (SELECT schema_hash FROM hc) GROUP BY ALL),
reg AS (SELECT dataset, schema_hash, CAST(NULL AS VARCHAR) AS first_batch, CAST(1 AS BIGINT) AS version, 'active' AS status FROM ds, hc UNION ALL SELECT dataset, schema_hash, first_batch, 1 + row_number() OVER (PARTITION BY dataset ORDER BY first_batch, schema_hash), 'candidate' FROM fresh)"""


def _decisions(rows: DataFrame) -> DataFrame:
    b = rows.select(*BATCH, F.substring("batch_id", 2, 2).cast("int").alias("n")).distinct()
    made = lambda left, decision, actor, reason, at: b.where(F.col("n") % 7 == left).select(*BATCH, F.lit(decision).alias("decision"), F.lit(actor).alias("actor"), F.lit(reason).cast("string").alias("reason"), (F.col("n") + at).alias("at"))
    out = made(1, "approve", "ann", None, 100)
    for x in ((2, "reject", "bob", "wrong file", 50), (3, "reject", "bob", "wrong file", 50), (3, "approve", "eve", None, 150), (4, "rollback", "ann", "old schema", 10)):
        out = out.unionByName(made(*x))
    return out


def _registered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    facts = _facts(spark, sf_dir)
    known = registry.canonical_versions(registry.schema_hash(_canonical(spark, facts), ("dataset",)))
    hashes = stored(registry.schema_hash(facts), "hashes")
    return stored(registry.with_candidates(known, hashes), "registry"), hashes


@R.query(f"WITH {_REGISTRY} SELECT * FROM reg")
def registry_candidates(spark, sf_dir):
    return registry.listed(_registered(spark, sf_dir)[0])


@R.query(f"""WITH {_REGISTRY}, acts AS (SELECT lat.dataset, CASE WHEN decision = 'rollback' THEN (SELECT schema_hash FROM hc) ELSE hb.schema_hash END AS wanted, made, hb.batch_id FROM lat JOIN hb USING (dataset, batch_id) WHERE decision IN ('approve', 'rollback')), last AS (SELECT dataset, max_by(wanted, made) AS wanted FROM acts GROUP BY 1)
SELECT r.dataset, r.schema_hash, r.first_batch, r.version, CASE WHEN l.wanted IS NULL THEN status WHEN r.schema_hash = l.wanted THEN 'active' WHEN status = 'active' OR EXISTS (SELECT 1 FROM acts a WHERE a.dataset = r.dataset AND a.wanted = r.schema_hash) THEN 'retired' ELSE status END AS status FROM reg r LEFT JOIN last l USING (dataset)""")
def registry_activated(spark, sf_dir):
    reg, hashes = _registered(spark, sf_dir)
    then = hashes.join(registry.active(reg).select("dataset", F.col("schema_hash").alias("active_hash")), "dataset")
    return registry.activated(reg, then, _decisions(hashes))


@R.query(f"""WITH {_REGISTRY} SELECT b.dataset, b.batch_id, r.version, b.schema_hash = (SELECT schema_hash FROM hc) AS is_active FROM hb b JOIN reg r ON r.dataset = b.dataset AND r.schema_hash = b.schema_hash""")
def registry_by_hash(spark, sf_dir):
    reg, hashes = _registered(spark, sf_dir)
    now = registry.active(reg).select("dataset", F.col("schema_hash").alias("active_hash"))
    return hashes.join(registry.newest_version(reg), ["dataset", "schema_hash"]).join(now, "dataset").select(*BATCH, "version", (F.col("schema_hash") == F.col("active_hash")).alias("is_active"))


@R.query(f"""WITH {_FACTS}, {_DECISIONS} SELECT t.dataset, t.batch_id, c_custkey AS row_no, CASE WHEN decision IN ('approve', 'rollback') THEN 'production' WHEN decision = 'reject' THEN 'rejected' ELSE 'staging' END AS place, CASE WHEN decision IN ('approve', 'rollback') THEN 'PROMOTED' WHEN decision = 'reject' THEN 'REJECTED' ELSE 'PENDING' END AS status,
 actor AS decided_by, CASE WHEN decision = 'reject' THEN reason END AS reject_reason FROM t LEFT JOIN lat ON lat.dataset = t.dataset AND lat.batch_id = t.batch_id""")
def staged_rows_decided(spark, sf_dir):
    rows = batches(spark, sf_dir).select(*BATCH, "row_no")
    return registry.apply_decisions(rows, _decisions(rows))


@R.query("SELECT c_custkey, c_name, c_nationkey, round(CAST(printf('%.2f', c_acctbal) AS DOUBLE), 2) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def rows_rolled_back(spark, sf_dir):
    """Rows that lack a column and have another, in the canonical schema."""
    t = table(spark, sf_dir, "customer")
    new = t.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("string").alias("c_nationkey"), F.format_string("%.2f", "c_acctbal").alias("c_acctbal"), F.lit("gold").alias("loyalty"))
    types = {"int": "bigint", "float": "double", "string": "string"}
    return registry.rollback(new, [(c, types[k]) for c, k, _ in CANONICAL])


# events of the driver's table as lines of an audit log
_STATUS = "CASE WHEN event_id % 11 = 0 THEN 'PROMOTED' WHEN event_id % 11 = 1 THEN 'REJECTED' WHEN event_type = 'view' THEN 'APPROVED' ELSE 'PENDING' END"
_EVENTS = f"""ev AS (SELECT event_id, ts, 'DS' || (user_id % 4) AS dataset, 'b' || (event_id % 500) AS batch_id, event_type, floor(value * 100) / 10000 AS risk, CASE WHEN value >= 100 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS level, {_STATUS} AS status, CASE WHEN event_type = 'view' THEN 'production' ELSE 'staging' END AS route, CASE WHEN event_id % 11 < 2 THEN epoch(ts) + event_id % 977 END AS decided_at FROM events)"""


def _event_table(spark, sf_dir) -> DataFrame:
    c = F.col
    status = F.when(c("event_id") % 11 == 0, "PROMOTED").when(c("event_id") % 11 == 1, "REJECTED").when(c("event_type") == "view", "APPROVED").otherwise("PENDING")
    level = F.when(c("value") >= 100, "high").when(c("value") >= 30, "medium").otherwise("low")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat(F.lit("DS"), (c("user_id") % 4).cast("string")).alias("dataset"), F.concat(F.lit("b"), (c("event_id") % 500).cast("string")).alias("batch_id"), "event_type", (F.floor(c("value") * 100) / 10000).alias("risk"), level.alias("level"), status.alias("status"),
        F.when(c("event_type") == "view", "production").otherwise("staging").alias("route"), F.when(c("event_id") % 11 < 2, c("ts").cast("timestamp").cast("double") + c("event_id") % 977).alias("decided_at"),
    )


def _names(spark) -> DataFrame:
    return spark.createDataFrame([("DS0", "zero"), ("DS1", "one"), ("DS2", "two")], "dataset string, dataset_name string")


@R.query(f"WITH {_EVENTS} SELECT event_id, ev.dataset, dataset_name, status FROM ev LEFT JOIN (VALUES ('DS0', 'zero'), ('DS1', 'one'), ('DS2', 'two')) n(dataset, dataset_name) USING (dataset) WHERE status = 'REJECTED' AND route = 'staging' ORDER BY ts DESC, event_id LIMIT 200")
def events_filtered(spark, sf_dir):
    out = registry.event_list(_event_table(spark, sf_dir), _names(spark), status="rejected", route="staging", actioned="yes")
    return out.select("event_id", "dataset", "dataset_name", "status")


@R.query(f"WITH {_EVENTS} SELECT event_id, dataset, batch_id, risk FROM ev WHERE route = 'staging' AND status = 'PENDING' ORDER BY ts DESC, event_id LIMIT 200")
def staging_queue(spark, sf_dir):
    return registry.staging_queue(_event_table(spark, sf_dir)).select("event_id", "dataset", "batch_id", "risk")


@R.query(f"WITH {_EVENTS} SELECT event_id, batch_id, (SELECT count(*) FROM ev WHERE route = 'staging') AS total FROM ev WHERE route = 'staging' ORDER BY event_id LIMIT 50 OFFSET 100")
def staged_page(spark, sf_dir):
    return registry.page(_event_table(spark, sf_dir).where("route = 'staging'").select("event_id", "batch_id"), "event_id", 100, 50)


@R.query(f"WITH {_EVENTS} SELECT event_id, batch_id FROM ev WHERE route = 'staging' AND event_id > 500 ORDER BY event_id LIMIT 50")
def staged_page_after(spark, sf_dir):
    return registry.page_after(_event_table(spark, sf_dir).where("route = 'staging'").select("event_id", "batch_id"), "event_id", 500, 50)


@R.query(f"WITH {_EVENTS} SELECT count(*) AS total, count(*) FILTER (level = 'high') AS high, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (route = 'staging') AS staging, count(*) FILTER (status = 'PROMOTED') AS promoted FROM ev")
def governance_kpis(spark, sf_dir):
    return registry.kpis(_event_table(spark, sf_dir))


@R.query(f"WITH {_EVENTS} SELECT event_id, status FROM ev WHERE decided_at IS NOT NULL ORDER BY decided_at DESC, event_id LIMIT 6")
def recent_actions(spark, sf_dir):
    return registry.recent_actions(_event_table(spark, sf_dir)).select("event_id", "status")


@R.query(f"WITH {_EVENTS} SELECT dataset, batch_id, '[rejected] ' || dataset || ' / ' || batch_id || ' (' || upper(level) || ')' AS subject, 'risk: ' || printf('%.4f', risk) || chr(10) || 'by: ' || CASE WHEN event_id % 2 = 0 THEN 'bob' ELSE '-' END || chr(10) || 'reason: ' || event_type AS body FROM ev WHERE status = 'REJECTED'")
def reject_alerts(spark, sf_dir):
    e = _event_table(spark, sf_dir).where("status = 'REJECTED'")
    return registry.alerts(e.select(*BATCH, "level", F.format_string("%.4f", "risk").alias("risk"), F.when(F.col("event_id") % 2 == 0, "bob").alias("actor"), F.col("event_type").alias("reason")))


_TIME = "CASE event_id % 3 WHEN 0 THEN 'created_at' WHEN 1 THEN 'ts' ELSE 'timestamp' END"
_KINDS = "CASE event_type WHEN 'click' THEN '[\"ADD\"]' WHEN 'purchase' THEN '[\"REMOVE\",\"TYPE_CHANGE\"]' ELSE '[]' END"
_DIFF = "CASE event_type WHEN 'click' THEN '{\"added\":[\"x\",\"y\"]}' WHEN 'purchase' THEN '{\"removed\":[\"z\"],\"type_changes\":[{\"column\":\"v\",\"from\":\"int\",\"to\":\"string\"}]}' WHEN 'signup' THEN '{\"added\":[\"n\"],\"nullable_changes\":[{\"column\":\"q\"}]}' ELSE '{}' END"
_MAPPED = "CASE WHEN event_type = 'signup' THEN '{\"mappings\":{\"a\":\"b\",\"c\":\"d\"}}' ELSE '{}' END"


def _lines(spark, sf_dir) -> DataFrame:
    """One JSON line an event, under different names; every 97th is no JSON and every 89th has no time."""
    e = _event_table(spark, sf_dir).withColumn("time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    when = F.when(F.col("event_id") % 89 == 0, "").otherwise(F.concat(F.lit('"'), F.expr(_TIME.replace("'", "'")), F.lit('":"'), "time", F.lit('",')))
    own = F.concat(F.lit('"'), F.when(F.col("event_id") % 2 == 0, "dataset").otherwise("dataset_name"), F.lit('":"'), "dataset", F.lit('",'))
    line = F.concat(
        F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(","), when, own, F.lit('"batch_id":"'), "batch_id", F.lit('","drift_types":'), F.expr(_KINDS), F.lit(',"diff":'), F.expr(_DIFF), F.lit(',"renames":'), F.expr(_MAPPED),
        F.lit(',"risk_score":"'), F.format_string("%.4f", "risk"), F.lit('","risk_level":"'), "level", F.lit('","decision_by":'), F.when(F.col("event_id") % 11 == 1, '"bob"').otherwise("null"), F.lit(',"route_applied":"'), "route", F.lit('"}'),
    )
    return e.select(F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(line).alias("line"))


_LINE = f"""ln AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'broken ' || event_id ELSE '{{"event_id":' || event_id || ',' || CASE WHEN event_id % 89 = 0 THEN '' ELSE '"' || {_TIME} || '":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '",' END || '"' || CASE WHEN event_id % 2 = 0 THEN 'dataset' ELSE 'dataset_name' END || '":"' || dataset || '","batch_id":"' || batch_id || '","drift_types":' || {_KINDS} || ',"diff":' || {_DIFF} || ',"renames":' || {_MAPPED}
 || ',"risk_score":"' || printf('%.4f', risk) || '","risk_level":"' || level || '","decision_by":' || CASE WHEN event_id % 11 = 1 THEN '"bob"' ELSE 'null' END || ',"route_applied":"' || route || '"}}' END AS line, event_id % 97 <> 0 AS ok FROM ev)"""
_SET = {"ts": "CASE WHEN event_id % 89 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '' END", "dataset": "dataset", "event_id": "CAST(event_id AS VARCHAR)", "batch_id": "batch_id", "approver": "CASE WHEN event_id % 11 = 1 THEN 'bob' ELSE '' END", "drift_types": "CASE event_type WHEN 'click' THEN 'ADD' WHEN 'purchase' THEN 'REMOVE,TYPE_CHANGE' ELSE '' END", "risk_score": "printf('%.4f', risk)", "risk_level": "level", "route_applied": "route"}
_AUDIT = ", ".join(f"CASE WHEN ok THEN {_SET.get(c, repr(''))} ELSE '' END AS {c}" for c, _ in audit.COLUMNS)


@R.query(f"WITH {_EVENTS}, {_LINE} SELECT {_AUDIT}, line AS raw_json FROM ln")
def audit_flatten(spark, sf_dir):
    return audit.audit_table(_lines(spark, sf_dir))


@R.query(f"""WITH {_EVENTS}, {_LINE}, a AS (SELECT {_AUDIT} FROM ln) SELECT event_id, CASE WHEN drift_types <> '' THEN 'DRIFT' ELSE 'EVENT' END AS label, concat_ws(' | ', CASE WHEN batch_id <> '' THEN 'batch=' || batch_id END, CASE WHEN drift_types <> '' THEN 'drift=' || drift_types END, CASE WHEN risk_score <> '' THEN 'risk=' || risk_score END,
 CASE WHEN risk_level <> '' THEN 'level=' || risk_level END, CASE WHEN route_applied <> '' THEN 'route=' || route_applied END, CASE WHEN approver <> '' THEN 'by=' || approver END) AS summary_line FROM a""")
def audit_lines(spark, sf_dir):
    return audit.one_line(audit.audit_table(_lines(spark, sf_dir))).select("event_id", "label", "summary_line")


@R.query(f"""WITH {_EVENTS}, {_LINE} SELECT event_id, CASE WHEN event_id % 89 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS seen FROM ln WHERE ok AND dataset = 'DS2'""")
def event_log(spark, sf_dir):
    rows = audit.in_order(audit.read_events(_lines(spark, sf_dir), " ds2"))
    return rows.select(F.col("f")["event_id"].cast("long").alias("event_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@R.query(f"""WITH {_EVENTS}, {_LINE} SELECT CAST(event_id AS VARCHAR) AS event_id, dataset, batch_id, CASE WHEN event_id % 89 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE '' END AS created_at, CASE event_type WHEN 'click' THEN 'ADD' WHEN 'purchase' THEN 'REMOVE,TYPE_CHANGE' WHEN 'signup' THEN 'ADD,NULLABLE_CHANGE,RENAME' ELSE '' END AS drift_types,
 CASE event_type WHEN 'click' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS added_count, CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS removed_count, CASE event_type WHEN 'signup' THEN 2 ELSE 0 END AS rename_count, CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS type_change_count, CASE event_type WHEN 'signup' THEN 1 ELSE 0 END AS nullable_change_count,
 CASE event_type WHEN 'click' THEN 'x, y' WHEN 'signup' THEN 'n' ELSE '' END AS added_cols, CASE event_type WHEN 'purchase' THEN 'z' ELSE '' END AS removed_cols, CASE event_type WHEN 'signup' THEN 'a->b; c->d' ELSE '' END AS rename_pairs, CASE event_type WHEN 'purchase' THEN 'v:int->string' ELSE '' END AS type_changes FROM ln WHERE ok""")
def event_rows(spark, sf_dir):
    return audit.event_rows(_lines(spark, sf_dir))


@R.query("SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS text_processed, count(*) FILTER (event_type = 'click') AS image_processed, count(DISTINCT user_id % 13) AS active_agents, round(avg(value / 10), 6) AS avg_seconds FROM events")
def pipeline_counters(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "text").when(F.col("event_type") == "click", "image").otherwise("other")
    return audit.counters(table(spark, sf_dir, "events").select(kind.alias("kind"), (F.col("user_id") % 13).alias("agent"), (F.col("value") / 10).alias("seconds")))


_SCHEMA_ROWS = """names AS (SELECT p_brand, p_partkey, p_type || CASE WHEN p_partkey % 3 = 0 THEN '!' ELSE '' END AS name, CASE p_size % 6 WHEN 0 THEN 'DECIMAL(10,2)' WHEN 1 THEN ' BigInt' WHEN 2 THEN 'date' WHEN 3 THEN 'boolean' WHEN 4 THEN 'blob' END AS type, CASE p_size % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'Yes' WHEN 2 THEN 'perhaps' END AS nullable FROM part)"""


@R.query(f"""WITH {_SCHEMA_ROWS}, n AS (SELECT *, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '_') AS norm, lower(trim(type)) AS lt FROM names), f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, norm ORDER BY p_partkey) AS k FROM n WHERE norm <> '')
SELECT p_brand AS dataset, 'v0' AS version, norm AS name, CASE WHEN lt LIKE 'decimal%' THEN 'float' WHEN lt = 'bigint' THEN 'int' WHEN lt = 'date' THEN 'datetime' WHEN lt = 'boolean' THEN 'bool' ELSE 'string' END AS type, CASE lower(trim(nullable)) WHEN 'no' THEN false ELSE true END AS nullable, false AS primary_key, '' AS description FROM f WHERE k = 1""")
def canonical_schemas(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    c = F.col
    kind = F.when(c("p_size") % 6 == 0, "DECIMAL(10,2)").when(c("p_size") % 6 == 1, " BigInt").when(c("p_size") % 6 == 2, "date").when(c("p_size") % 6 == 3, "boolean").when(c("p_size") % 6 == 4, "blob")
    nullable = F.when(c("p_size") % 4 == 0, "no").when(c("p_size") % 4 == 1, "Yes").when(c("p_size") % 4 == 2, "perhaps")
    column = F.struct(F.concat("p_type", F.when(c("p_partkey") % 3 == 0, "!").otherwise("")).alias("name"), kind.alias("type"), nullable.alias("nullable"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", column.alias("c")))), lambda x: x["c"])
    documents = t.groupBy("p_brand").agg(F.to_json(F.struct(ordered.alias("columns"), F.first("p_brand").alias("name"))).alias("document"))
    return N.canonical_schema(documents, "document").drop("pos")


_KEYS = "name IN ('id') OR regexp_matches(name, '^id$|_id$|customer|user|device|timestamp|time$|date$|amount|price|total|email')"


@R.query(f"""WITH n AS (SELECT DISTINCT p_brand, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') || CASE p_partkey % 5 WHEN 0 THEN '_id' WHEN 1 THEN '_date' WHEN 2 THEN '_price' WHEN 3 THEN '_note' ELSE '_dates' END AS name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY name) AS k FROM n WHERE {_KEYS})
SELECT p_brand, array_to_string(list(name ORDER BY k), ',') AS keys FROM r WHERE k <= 12 GROUP BY 1""")
def key_suggestions(spark, sf_dir):
    c = F.col("p_partkey") % 5
    end = F.when(c == 0, "_id").when(c == 1, "_date").when(c == 2, "_price").when(c == 3, "_note").otherwise("_dates")
    names = table(spark, sf_dir, "part").select("p_brand", F.concat(N.norm_name(F.col("p_type")), end).alias("name"))
    return N.key_suggestions(names, "p_brand", "name").withColumn("keys", F.array_join("keys", ","))


@R.query("SELECT c_custkey, c_name AS full_name, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS packings FROM customer")
def rows_unwrapped(spark, sf_dir):
    """Rows packed no, one or three times, found again."""
    t = table(spark, sf_dir, "customer")
    row = F.to_json(F.struct(F.col("c_name").alias("Full Name")))
    wrap = lambda x, depth: wrap(F.concat(F.lit('{"canonical":{"full_name":null},"raw":'), x, F.lit("}")), depth - 1) if depth else x
    n = F.col("c_custkey") % 3
    packed = F.when(n == 0, row).when(n == 1, wrap(row, 1)).otherwise(wrap(row, 3))
    depth = F.size(F.split(packed, '"canonical"')) - 1
    return t.select("c_custkey", registry.unpacked(packed)["Full Name"].alias("full_name"), depth.alias("packings"))


@R.query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS name FROM customer")
def packed_layers(spark, sf_dir):
    """The canonical part that holds something, wherever a faulty packing put it."""
    t = table(spark, sf_dir, "customer")
    full = lambda c: F.to_json(F.struct(F.struct(F.col(c).alias("name")).alias("canonical"), F.struct(F.lit(1).alias("x")).alias("raw")))
    inner = F.concat(F.lit('{"canonical":{"name":null},"extras":'), full("c_mktsegment"), F.lit(',"raw":{}}'))
    return t.select("c_custkey", registry.best_canonical(F.when(F.col("c_custkey") % 2 == 0, full("c_name")).otherwise(inner), ["name"])["name"].alias("name"))


@R.query("SELECT conv_id, turn, coalesce(CASE WHEN turn % 2 = 0 THEN 'm' || conv_id END, 'unknown') AS id, CASE WHEN turn % 3 = 0 THEN 'done' ELSE 'received' END AS status, CASE WHEN role = 'user' THEN 'en' ELSE 'unknown' END AS language, 0 AS n_tokens, text FROM conversations")
def message_defaults(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    m = t.withColumn("id", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("m"), F.col("conv_id").cast("string")))).withColumn("status", F.when(F.col("turn") % 3 == 0, "done")).withColumn("language", F.when(F.col("role") == "user", "en")).withColumn("tokens", F.lit(None).cast("array<string>"))
    return N.with_defaults(m, {"id": F.lit("unknown"), "status": F.lit("received"), "language": F.lit("unknown"), "tokens": F.array().cast("array<string>")}).select("conv_id", "turn", "id", "status", "language", F.size("tokens").alias("n_tokens"), "text")


@R.query("SELECT DISTINCT p_size, CASE p_size % 8 WHEN 0 THEN 'float' WHEN 1 THEN 'int' WHEN 2 THEN 'bool' WHEN 3 THEN 'datetime' WHEN 4 THEN 'string' WHEN 5 THEN 'float' WHEN 6 THEN 'datetime' ELSE 'int' END AS type FROM part")
def type_names(spark, sf_dir):
    names = ("Decimal(12,2)", " BIGINT", "boolean", "timestamp", "varchar(9)", "Number", "DATE", "smallint")
    name = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("p_size") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_size", N.logical_type(name).alias("type")).distinct()


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 3 THEN l_tax END AS tax FROM lineitem")
def nan_values(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", N.nan_to_null(F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_tax"))).alias("tax"))
