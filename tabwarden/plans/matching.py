"""Queries of rename matching, risk and reports on batches of customers, with SQL that computes every score.

A nation is a batch; five nations are a data set.  Nations carry other columns from one to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.functions.stored import stored
from tabwarden.operators import drift, matching, profile, reports, risk
from tabwarden.operators.profile import BATCH
from tabwarden.plans.register import Registry, table

R = Registry()

CANONICAL = (("c_custkey", "int", False), ("c_name", "string", False), ("c_nationkey", "int", False), ("c_acctbal", "float", False), ("c_mktsegment", "string", True))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").withColumn("k", F.col("c_nationkey") % 5)
    k, key = F.col("k"), F.col("c_custkey")
    balance = F.format_string("%.2f", "c_acctbal")
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    segment = F.when(key % 10 != 3, F.col("c_mktsegment"))
    payload = F.map_concat(
        F.create_map(F.when(k == 4, "Customer Id").otherwise("c_custkey"), key.cast("string"), F.when(k == 1, "fullName").otherwise("c_name"), F.col("c_name"), F.lit("c_nationkey"), F.col("c_nationkey").cast("string")),
        F.create_map(F.when(k == 1, "account balance").when(k == 4, "Balance (USD)").otherwise("c_acctbal"), balance),
        F.when(k == 2, nothing).otherwise(F.create_map(F.when(k == 4, "Segment").otherwise("c_mktsegment"), segment)),
        F.when(k == 3, F.create_map(F.lit("loyalty_code"), F.concat(F.lit("L"), (key % 7).cast("string")))).otherwise(nothing),
    )
    return t.select(F.format_string("d%d", F.expr("c_nationkey div 5")).alias("dataset"), F.format_string("n%02d", "c_nationkey").alias("batch_id"), key.alias("row_no"), payload.alias("payload"))


_TYPED = "CASE WHEN nx / n_rows > 0.8 AND nw / nx > 0.95 THEN 'int' WHEN nx / n_rows > 0.8 THEN 'float' ELSE 'string' END"
_FACTS = f"""t AS (SELECT *, c_nationkey % 5 AS k, printf('n%02d', c_nationkey) AS batch_id, 'd' || (c_nationkey // 5) AS dataset FROM customer),
raw AS (SELECT dataset, batch_id, c_custkey AS rn, CASE WHEN k = 4 THEN 'customer_id' ELSE 'c_custkey' END AS "column", CAST(c_custkey AS VARCHAR) AS value FROM t
 UNION ALL SELECT dataset, batch_id, c_custkey, CASE WHEN k = 1 THEN 'fullname' ELSE 'c_name' END, c_name FROM t UNION ALL SELECT dataset, batch_id, c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM t
 UNION ALL SELECT dataset, batch_id, c_custkey, CASE WHEN k = 1 THEN 'account_balance' WHEN k = 4 THEN 'balance_usd' ELSE 'c_acctbal' END, printf('%.2f', c_acctbal) FROM t
 UNION ALL SELECT dataset, batch_id, c_custkey, CASE WHEN k = 4 THEN 'segment' ELSE 'c_mktsegment' END, CASE WHEN c_custkey % 10 <> 3 THEN c_mktsegment END FROM t WHERE k <> 2
 UNION ALL SELECT dataset, batch_id, c_custkey, 'loyalty_code', 'L' || (c_custkey % 7) FROM t WHERE k = 3),
rows_ AS (SELECT batch_id, count(*) AS n_rows FROM t GROUP BY 1), num AS (SELECT *, CASE WHEN NOT regexp_matches(value, '[A-Za-z:]') THEN TRY_CAST(value AS DOUBLE) END AS x FROM raw),
sums AS (SELECT dataset, batch_id, "column", count(value) AS n, count(x) AS nx, count(*) FILTER (x = floor(x)) AS nw, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max FROM num GROUP BY ALL),
typed AS (SELECT dataset, batch_id, "column", round(1 - n / n_rows, 6) AS null_rate, {_TYPED} AS type, n < n_rows AS nullable, mean, std, min, max FROM sums JOIN rows_ USING (batch_id)),
facts AS (SELECT dataset, batch_id, "column", null_rate, type, nullable, CASE WHEN type <> 'string' THEN round(mean, 6) END AS mean, CASE WHEN type <> 'string' THEN round(std, 6) END AS std, CASE WHEN type <> 'string' THEN round(min, 6) END AS min, CASE WHEN type <> 'string' THEN round(max, 6) END AS max FROM typed),
firsts AS (SELECT batch_id, "column", list(value ORDER BY rn)[1:20] AS examples FROM raw WHERE value IS NOT NULL GROUP BY ALL),
fr AS (SELECT dataset, "column", trim(value) AS v, count(*) AS n FROM raw WHERE value IS NOT NULL AND CAST(batch_id[2:] AS INT) % 5 = 0 GROUP BY ALL), often AS (SELECT dataset, "column", list(v ORDER BY n DESC, v)[1:8] AS examples FROM fr GROUP BY ALL),
canon(c, ct, cn) AS (VALUES {', '.join(f"('{c}', '{t}', {str(n).lower()})" for c, t, n in CANONICAL)}), ds AS (SELECT DISTINCT dataset FROM t),
base AS (SELECT ds.dataset, c AS "column", ct AS type, f.dataset IS NOT NULL AS present, coalesce(null_rate, 1.0) AS null_rate, mean, std, min, max, coalesce(examples, []) AS examples FROM ds CROSS JOIN canon LEFT JOIN (SELECT * FROM facts WHERE CAST(batch_id[2:] AS INT) % 5 = 0) f ON f.dataset = ds.dataset AND f."column" = c LEFT JOIN often o ON o.dataset = ds.dataset AND o."column" = c)"""
_CHANGES = f"""{_FACTS}, b AS (SELECT DISTINCT dataset, batch_id FROM t), w AS (SELECT * FROM b, canon), j AS (SELECT coalesce(w.dataset, f.dataset) AS dataset, coalesce(w.batch_id, f.batch_id) AS batch_id, coalesce(c, "column") AS "column", ct, cn, type, nullable FROM w FULL JOIN facts f ON w.batch_id = f.batch_id AND c = "column"),
changes AS (SELECT dataset, batch_id, 'ADD' AS kind, "column", CAST(NULL AS VARCHAR) AS old, type AS new FROM j WHERE ct IS NULL UNION ALL SELECT dataset, batch_id, 'REMOVE', "column", ct, NULL FROM j WHERE type IS NULL
 UNION ALL SELECT dataset, batch_id, 'TYPE_CHANGE', "column", ct, type FROM j WHERE ct <> type UNION ALL SELECT dataset, batch_id, 'NULLABLE_CHANGE', "column", 'false', 'true' FROM j WHERE NOT cn AND nullable)"""


def _facts(spark, sf_dir) -> DataFrame:
    return stored(profile.column_facts(batches(spark, sf_dir)), "facts")


def _canonical(spark, facts: DataFrame) -> DataFrame:
    columns = spark.createDataFrame(CANONICAL, "column string, type string, nullable boolean")
    return facts.select("dataset").distinct().join(columns)  # data sets by canonical columns


def _baseline(spark, sf_dir, facts: DataFrame) -> DataFrame:
    """Of each data set, the nation whose batch has all columns."""
    whole = F.substring("batch_id", 2, 2).cast("int") % 5 == 0
    rows = batches(spark, sf_dir).where(whole)
    return profile.baseline(_canonical(spark, facts), facts.where(whole), profile.frequent_values(rows, as_array=True))


@R.query(f"""WITH {_FACTS} SELECT dataset, "column", type, present, null_rate, coalesce(mean, 0) AS mean, coalesce(std, 0) AS std, array_to_string(examples, '|') AS examples FROM base""")
def baseline_aligned(spark, sf_dir):
    b = _baseline(spark, sf_dir, _facts(spark, sf_dir))
    return b.select("dataset", "column", "type", "present", "null_rate", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"), F.array_join("examples", "|").alias("examples"))


@R.query(f"""WITH {_FACTS} SELECT dataset, batch_id, "column", 'column_name=' || "column" || chr(10) || 'type=' || type || chr(10) || 'null_rate=' || printf('%.3f', null_rate) || chr(10) || 'examples=[' || array_to_string(list_transform(coalesce(examples, [])[1:10], lambda x: '''' || x || ''''), ', ') || ']' || chr(10) AS description,
 array_to_string(coalesce(examples, []), '|') AS examples FROM facts LEFT JOIN firsts USING (batch_id, "column")""")
def column_descriptions(spark, sf_dir):
    joined = _facts(spark, sf_dir).join(profile.first_values(batches(spark, sf_dir)), [*BATCH, "column"], "left")
    examples = profile.usable_examples(F.col("examples"))
    return joined.select(*BATCH, "column", matching.description(F.col("column"), F.col("type"), F.col("null_rate"), examples).alias("description"), F.array_join(examples, "|").alias("examples"))


def _text(side: str) -> str:
    return f"""'column_name=' || {side}_name || chr(10) || 'type=' || {side}_type || chr(10) || 'null_rate=' || printf('%.3f', coalesce({side}_null, 0.0)) || chr(10) || 'examples=[' || array_to_string(list_transform(coalesce({side}_ex, [])[1:10], lambda x: '''' || x || ''''), ', ') || ']' || chr(10)"""


def _words(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split({x}, '_'), lambda w: w <> ''), lambda w: CASE WHEN w IN ({', '.join(repr(w) for w in matching.ID_WORDS)}) THEN 'id' ELSE w END))"


def _jac(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) END)"


_LETTERS = "string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z,0,1,2,3,4,5,6,7,8,9,_', ',')"


def _alike(a: str, b: str) -> str:
    shared = f"list_sum(list_transform({_LETTERS}, lambda l: least(len({a}) - len(replace({a}, l, '')), len({b}) - len(replace({b}, l, '')))))"
    return f"(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.6 * {_jac(f'list_distinct(string_split({a}, chr(95)))', f'list_distinct(string_split({b}, chr(95)))')} + 0.4 * {shared} / greatest(len({a}), len({b})) END)"


def _meaning(name: str, kind: str) -> str:
    return f"CASE WHEN {kind} = 'datetime' THEN 'date' WHEN regexp_matches({name}, '{'|'.join(matching.ID_PARTS)}') THEN 'id' WHEN regexp_matches({name}, '{'|'.join(matching.DATE_PARTS)}') THEN 'date' WHEN {kind} IN ('int', 'float') THEN 'numeric' WHEN {kind} = 'string' THEN 'string' ELSE 'other' END"


_BOTH = "old_type IN ('int', 'float') AND new_type IN ('int', 'float')"
_SCORED = f"""{_CHANGES}, pairs AS (SELECT r.dataset, r.batch_id, r."column" AS old_name, r.old AS old_type, a."column" AS new_name, a.new AS new_type, bs.null_rate AS old_null, bs.mean AS b_mean, bs.std AS b_std, bs.examples AS old_ex, f.null_rate AS new_null, f.mean AS o_mean, f.std AS o_std, x.examples AS new_ex
 FROM changes r JOIN changes a ON r.batch_id = a.batch_id AND r.kind = 'REMOVE' AND a.kind = 'ADD' LEFT JOIN base bs ON bs.dataset = r.dataset AND bs."column" = r."column" LEFT JOIN facts f ON f.batch_id = r.batch_id AND f."column" = a."column" LEFT JOIN firsts x ON x.batch_id = r.batch_id AND x."column" = a."column"),
pt AS (SELECT *, {_text('old')} AS old_text, {_text('new')} AS new_text FROM pairs), txt AS (SELECT old_text AS t FROM pt UNION SELECT new_text FROM pt), pad AS (SELECT t, ' ' || regexp_replace(lower(t), '[ \\t\\r\\n\\f]+', ' ', 'g') || ' ' AS p FROM txt),
gram AS (SELECT t, unnest(list_transform(range(1, len(p) - n + 2), lambda i: substr(p, i, n))) AS g FROM pad, (VALUES (3), (4), (5)) v(n)), hits AS (SELECT t, CAST('0x' || substr(md5(g), 1, 2) AS INT) AS bucket, CAST(count(*) AS DOUBLE) AS h FROM gram GROUP BY ALL),
unit AS (SELECT t, bucket, h / sqrt(sum(h * h) OVER (PARTITION BY t)) AS w FROM hits), cosine AS (SELECT a.t AS old_text, b.t AS new_text, sum(a.w * b.w) AS emb FROM unit a JOIN unit b USING (bucket) GROUP BY ALL),
feat AS (SELECT dataset, batch_id, old_name, new_name, round({_alike('old_name', 'new_name')}, 6) AS name_sim, round({_jac(_words('old_name'), _words('new_name'))}, 6) AS token_jaccard, round(coalesce(emb, 0.0), 6) AS emb_sim, CAST(old_type = new_type OR ({_BOTH}) AS DOUBLE) AS type_compat,
 round(abs(coalesce(old_null, 0.0) - coalesce(new_null, 0.0)), 6) AS null_rate_diff, round(CASE WHEN {_BOTH} THEN coalesce(abs(b_mean - o_mean), 0.0) ELSE 0.0 END, 6) AS mean_diff, round(CASE WHEN {_BOTH} THEN coalesce(abs(b_std - o_std), 0.0) ELSE 0.0 END, 6) AS std_diff, CAST(0.0 AS DOUBLE) AS range_overlap,
 {_meaning('old_name', 'old_type')} = {_meaning('new_name', 'new_type')} AS same_class FROM pt LEFT JOIN cosine USING (old_text, new_text)),
scored AS (SELECT *, round(CASE WHEN type_compat = 0 THEN 0.0 ELSE 0.28 * name_sim + 0.18 * token_jaccard + 0.22 * emb_sim + 0.10 * type_compat + 0.07 * range_overlap + 0.05 / (1 + mean_diff) + 0.05 / (1 + std_diff) + 0.05 * (1 - least(null_rate_diff, 1.0)) END, 6) AS score, row_number() OVER (PARTITION BY batch_id, old_name ORDER BY emb_sim DESC, new_name) AS rank FROM feat)"""
_ASSIGNED = f"""{_SCORED}, good AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, emb_sim DESC, old_name, new_name) AS pos FROM scored WHERE rank <= 12 AND (score >= 0.58 OR emb_sim >= 0.55) AND NOT (NOT same_class AND score < 0.95 AND NOT (emb_sim >= 0.80 AND token_jaccard >= 0.25)) AND NOT (token_jaccard < 0.20 AND name_sim < 0.55 AND NOT (emb_sim >= 0.80 AND same_class))),
g(batch_id, pos, olds, news, took) AS (SELECT DISTINCT batch_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false FROM good
 UNION ALL SELECT g.batch_id, d.pos, CASE WHEN ok THEN list_append(olds, d.old_name) ELSE olds END, CASE WHEN ok THEN list_append(news, d.new_name) ELSE news END, ok FROM g JOIN good d ON d.batch_id = g.batch_id AND d.pos = g.pos + 1, LATERAL (SELECT NOT list_contains(olds, d.old_name) AND NOT list_contains(news, d.new_name) AS ok)),
ren AS (SELECT d.dataset, d.batch_id, d.old_name, d.new_name, CASE WHEN score >= 0.58 THEN score ELSE emb_sim END AS confidence FROM good d JOIN g USING (batch_id, pos) WHERE took),
final AS (SELECT * FROM changes c WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.batch_id = c.batch_id AND ((c.kind = 'REMOVE' AND c."column" = old_name) OR (c.kind = 'ADD' AND c."column" = new_name))) UNION ALL SELECT dataset, batch_id, 'RENAME', old_name, old_name, new_name FROM ren)"""


def _parts(spark, sf_dir) -> dict[str, DataFrame]:
    """Facts, changes, candidates, renames and final changes: each a small written table, from one scan for facts and one for examples."""
    facts = _facts(spark, sf_dir)
    found = stored(drift.changes(_canonical(spark, facts), facts), "changes")
    scored = stored(matching.candidates(found, _baseline(spark, sf_dir, facts), facts, profile.first_values(batches(spark, sf_dir))), "candidates")
    renames = stored(matching.assign(scored), "renames")
    return {"facts": facts, "found": found, "scored": scored, "renames": renames, "final": stored(drift.with_renames(found, renames), "final")}


@R.query(f"WITH {_SCORED} SELECT dataset, batch_id, old_name, new_name, {', '.join(matching.FEATURES)}, same_class, score, rank FROM scored WHERE rank <= 12")
def match_features(spark, sf_dir):
    return _parts(spark, sf_dir)["scored"]


@R.query(f"WITH RECURSIVE {_ASSIGNED} SELECT dataset, batch_id, old_name, new_name, confidence FROM ren")
def match_renames(spark, sf_dir):
    return _parts(spark, sf_dir)["renames"]


@R.query(f"""WITH RECURSIVE {_ASSIGNED}, placed AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, emb_sim DESC, old_name, new_name) AS place FROM scored WHERE rank <= 12)
SELECT p.batch_id, p.old_name, p.new_name, p.score, p.emb_sim, p.place, r.batch_id IS NOT NULL AS accepted, CAST(0.58 AS DOUBLE) AS threshold, CAST(0.55 AS DOUBLE) AS emb_threshold FROM placed p LEFT JOIN ren r ON r.batch_id = p.batch_id AND r.old_name = p.old_name AND r.new_name = p.new_name WHERE place <= 50""")
def match_report(spark, sf_dir):
    p = _parts(spark, sf_dir)
    out = matching.candidate_report(p["scored"], p["renames"], matching.heuristic_threshold(0.5359877))
    return out.select("batch_id", "old_name", "new_name", "score", "emb_sim", "place", "accepted", "threshold", "emb_threshold")


@R.query()
def match_learned(spark, sf_dir):
    """Candidates scored by a model that learned from the pairs of every second data set; tests hold it against the true pairs."""
    p = _parts(spark, sf_dir)
    true = F.concat_ws(">", "old_name", "new_name").isin("c_name>fullname", "c_acctbal>account_balance", "c_custkey>customer_id", "c_acctbal>balance_usd", "c_mktsegment>segment")
    learned = matching.train_scorer(p["scored"].where("dataset IN ('d0', 'd2', 'd4')").withColumn("label", true.cast("double")))
    return matching.candidates(p["found"], _baseline(spark, sf_dir, p["facts"]), p["facts"], profile.first_values(batches(spark, sf_dir)), scorer=learned, range_overlap=True)


_NAME = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"
_FULL = lambda x: "list_distinct(list_transform(string_split(" + x + ", '_'), lambda w: CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in matching.ABBREVIATIONS.items()) + " ELSE w END))"


@R.query(
    f"""WITH d AS (SELECT DISTINCT p_brand || ' qty' AS a, p_type || '_quantity' AS b FROM part), n AS (SELECT a, b, {_NAME('a')} AS x, {_NAME('b')} AS y FROM d)
SELECT a, b, round({_alike('x', 'y')}, 6) AS name_sim, round({_jac(_words('x'), _words('y'))}, 6) AS token_sim, round(CASE WHEN x = y THEN 1.0 ELSE 0.55 * (1 - CAST(levenshtein(x, y) AS DOUBLE) / greatest(len(x), len(y))) + 0.30 * {_jac(_FULL('x'), _FULL('y'))} + 0.15 * len(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: i <= least(len(x), len(y)) AND x[1:i] = y[1:i])) / greatest(len(x), len(y)) END, 6) AS abbreviation_sim,
 {_meaning('lower(a)', "'int'")} AS meaning, CASE WHEN regexp_matches(lower(b), '(^|[^a-z0-9])({'|'.join(matching.ID_PARTS)})($|[^a-z0-9])') THEN 'id' WHEN regexp_matches(lower(b), '(^|[^a-z0-9])({'|'.join(matching.DATE_PARTS)})($|[^a-z0-9])') THEN 'date' ELSE 'string' END AS meaning_by_words FROM n"""
)
def name_similarities(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    d = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(" qty")).alias("a"), F.concat("p_type", F.lit("_quantity")).alias("b")).distinct()
    return d.select(
        "a", "b", F.round(matching.name_similarity(a, b), 6).alias("name_sim"), F.round(matching.token_jaccard(a, b), 6).alias("token_sim"), F.round(matching.abbreviation_similarity(a, b), 6).alias("abbreviation_sim"),
        matching.semantic_class(a, F.lit("int")).alias("meaning"), matching.semantic_class(b, F.lit("string"), "token").alias("meaning_by_words"),
    )


_CONFIGS = (("d0", "A", "High", "PII", "Strict", ["C_ACCTBAL "]), ("d3", None, None, None, None, None), ("d4", " b ", "9", "Regulated", "Strict", None))
_OWN = (("d0", "B", "1", "None", "Light", None), ("d1", "A", "Low", "Regulated", "Light", ["c_name"]), ("d2", None, None, None, None, None), ("d3", "A", "2", "Regulated", "strict", None), ("d4", None, None, None, None, None))
_SHAPE = "dataset string, mode string, dataset_criticality string, sensitivity_class string, regulation_strictness string, key_fields array<string>"
_FIELDS = (("d0", "c_acctbal", 5, "Measure", "yes", "no", None, "no"), ("d4", "c_custkey", 9, "PK", None, None, None, "false"), ("d1", "c_mktsegment", None, None, "1", None, None, None), ("d4", "c_mktsegment", 1, "date", "t", None, None, "yes"))
_FIELD_SHAPE = "dataset string, column string, field_criticality int, semantic_type string, allow_remove string, allow_type_change string, allow_nullable_change string, allow_rename string"


def _value(x) -> str:
    return "NULL" if x is None else "[" + ", ".join(f"'{y}'" for y in x) + "]" if isinstance(x, list) else repr(x)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)


_CONFIG = f"""own(dataset, mode, crit, sens, strict, keys) AS (VALUES {_values(_OWN)}), cfg(dataset, mode, crit, sens, strict, keys) AS (VALUES {_values(_CONFIGS)}),
conf AS (SELECT o.dataset, CASE WHEN upper(trim(coalesce(CASE WHEN c.mode IS NULL THEN o.mode ELSE c.mode END, 'A'))) = 'B' THEN 'B' ELSE 'A' END AS mode, coalesce(CASE WHEN c.mode IS NULL THEN o.crit ELSE c.crit END, 'Medium') AS crit, coalesce(CASE WHEN c.mode IS NULL THEN o.sens ELSE c.sens END, 'None') AS sens,
 coalesce(CASE WHEN c.mode IS NULL THEN o.strict ELSE c.strict END, 'Light') AS strict, coalesce(CASE WHEN c.mode IS NULL THEN o.keys ELSE c.keys END, []) AS keys FROM own o LEFT JOIN cfg c USING (dataset))"""


def _config(spark) -> DataFrame:
    return risk.resolve_config(spark.createDataFrame(_OWN, _SHAPE), spark.createDataFrame(_CONFIGS, _SHAPE))


_SUMMARY = f"""{_ASSIGNED}, sm AS (SELECT b.dataset, b.batch_id, count(kind) FILTER (kind = 'REMOVE') AS n_remove, count(kind) FILTER (kind = 'TYPE_CHANGE') AS n_type_change, count(kind) FILTER (kind = 'RENAME') AS n_rename, count(kind) FILTER (kind = 'NULLABLE_CHANGE') AS n_nullable_change, count(kind) FILTER (kind = 'ADD') AS n_add,
 coalesce(max(CASE kind WHEN 'REMOVE' THEN 1.0 WHEN 'TYPE_CHANGE' THEN 0.9 WHEN 'RENAME' THEN 0.7 WHEN 'NULLABLE_CHANGE' THEN 0.5 WHEN 'ADD' THEN 0.4 END), 0.0) AS s_max FROM b LEFT JOIN final f ON f.batch_id = b.batch_id GROUP BY ALL),
af AS (SELECT batch_id, list_sort(list_distinct(flatten(list(CASE WHEN kind = 'RENAME' THEN ["column", new] ELSE ["column"] END)))) AS affected FROM final GROUP BY 1), un AS (SELECT batch_id, max(1 - least(greatest(confidence, 0), 1)) AS u FROM ren GROUP BY 1)"""


@R.query(f"""WITH RECURSIVE {_SUMMARY} SELECT dataset, batch_id, n_add, n_remove, n_type_change, n_nullable_change, n_rename, CAST(s_max AS DOUBLE) AS s_max, coalesce(array_to_string(affected, ','), '') AS affected, round(coalesce(u, 0.0), 6) AS uncertainty FROM sm LEFT JOIN af USING (batch_id) LEFT JOIN un USING (batch_id)""")
def risk_summary(spark, sf_dir):
    p = _parts(spark, sf_dir)
    joined = risk.summary(p["facts"], p["final"]).join(risk.uncertainty(p["renames"]), list(BATCH), "left")
    return joined.withColumn("affected", F.array_join("affected", ",")).withColumn("uncertainty", F.round(F.coalesce("uncertainty", F.lit(0.0)), 6))


@R.query(f"""WITH {_CONFIG} SELECT dataset, mode, crit AS dataset_criticality, sens AS sensitivity_class, strict AS regulation_strictness, array_to_string(keys, ',') AS key_fields, len(keys) AS key_fields_count, n AS batches FROM conf JOIN (SELECT 'd' || (c_nationkey // 5) AS dataset, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1) USING (dataset)""")
def risk_config(spark, sf_dir):
    n = batches(spark, sf_dir).groupBy("dataset").agg(F.count_distinct("batch_id").alias("batches"))
    return _config(spark).join(n, "dataset").withColumn("key_fields", F.array_join("key_fields", ",")).withColumn("key_fields_count", F.col("key_fields_count").cast("long"))


@R.query(f"""WITH RECURSIVE {_SUMMARY}, {_CONFIG}, x AS (SELECT sm.*, lower(trim(crit)) AS c, lower(trim(sens)) AS s, lower(trim(strict)) = 'strict' AS st, n_remove + n_type_change + n_rename + n_nullable_change + n_add AS n, len(list_intersect(list_transform(keys, lambda k: lower(trim(k))), coalesce(affected, []))) > 0 AS hit, coalesce(u, 0.0) AS u FROM sm JOIN conf USING (dataset) LEFT JOIN af USING (batch_id) LEFT JOIN un USING (batch_id)),
y AS (SELECT *, least(greatest(0.55 * least(1.0, s_max + 0.08 * ln(1.0 + n)) + 0.20 * CASE c WHEN 'low' THEN 0.3 WHEN 'high' THEN 0.9 ELSE 0.6 END + 0.20 * CASE s WHEN 'internal' THEN 0.2 WHEN 'pii' THEN 0.5 WHEN 'regulated' THEN 0.8 ELSE 0.0 END + 0.05 * CAST(hit AS INT), 0), 1) AS base, CASE WHEN s = 'regulated' THEN CASE WHEN n_remove + n_type_change > 0 THEN CASE WHEN st THEN 0.85 ELSE 0.75 END WHEN n_rename + n_nullable_change > 0 THEN CASE WHEN st THEN 0.70 ELSE 0.60 END WHEN n_add > 0 THEN CASE WHEN st THEN 0.50 ELSE 0.40 END END END AS floor FROM x),
z AS (SELECT *, round(greatest(CAST(least(base + 0.10 * u, 1) AS DOUBLE), coalesce(floor, 0)), 6) AS risk FROM y) SELECT dataset, batch_id, risk, CASE WHEN risk >= 0.70 THEN 'high' WHEN risk >= 0.35 THEN 'medium' ELSE 'low' END AS level, CASE WHEN risk >= 0.35 THEN 'staging' ELSE 'production' END AS suggested_route, CAST(floor AS DOUBLE) AS floor FROM z""")
def risk_mode_a(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return risk.mode_a(risk.summary(p["facts"], p["final"]), _config(spark), risk.uncertainty(p["renames"]))


_TRUE, _FALSE = "('true', '1', 'yes', 'y', 't')", "('false', '0', 'no', 'n', 'f', '')"
_ALLOW = lambda c, default: f"CASE WHEN lower(trim({c})) IN {_TRUE} THEN true WHEN lower(trim({c})) IN {_FALSE} THEN false ELSE {default} END"
_R = f"""{_SUMMARY}, {_CONFIG}, fld(dataset, "column", fc, sem, a_remove, a_type, a_null, a_rename) AS (VALUES {_values(_FIELDS)}),
rj AS (SELECT f.*, CASE kind WHEN 'REMOVE' THEN 1.0 WHEN 'TYPE_CHANGE' THEN 0.9 WHEN 'RENAME' THEN 0.7 WHEN 'NULLABLE_CHANGE' THEN 0.5 ELSE 0.4 END AS sev, 0.5 * least(greatest(coalesce(nullif(TRY_CAST(crit AS INT), 0), 3), 1), 5) / 5.0 + 0.5 * least(greatest(coalesce(nullif(fc, 0), 3), 1), 5) / 5.0 AS imp,
 CASE WHEN lower(trim(sem)) IN ('identifier', 'identifier/pk', 'pk', 'primary key', 'primary_key') THEN 1.0 WHEN lower(trim(sem)) IN ('foreign key', 'fk', 'foreign_key') THEN 0.9 WHEN lower(trim(sem)) IN ('timestamp', 'time', 'datetime', 'date') THEN 0.8 WHEN lower(trim(sem)) IN ('measure', 'metric', 'amount', 'value') THEN 0.7 ELSE 0.6 END AS m,
 lower(trim(sens)) AS s, lower(trim(strict)) = 'strict' AS st, CASE WHEN kind = 'REMOVE' AND NOT {_ALLOW('a_remove', 'false')} THEN 0.20 WHEN kind = 'TYPE_CHANGE' AND NOT {_ALLOW('a_type', 'false')} THEN 0.18 WHEN kind = 'NULLABLE_CHANGE' AND NOT {_ALLOW('a_null', 'true')} THEN 0.10 WHEN kind = 'RENAME' AND NOT {_ALLOW('a_rename', 'true')} THEN 0.12 ELSE 0.0 END AS p_tol,
 CASE WHEN kind = 'RENAME' THEN 0.15 * (1 - least(greatest(coalesce(confidence, 1.0), 0), 1)) ELSE 0.0 END AS p_conf FROM final f JOIN conf USING (dataset) LEFT JOIN fld USING (dataset, "column") LEFT JOIN ren ON ren.batch_id = f.batch_id AND f.kind = 'RENAME' AND ren.old_name = f."column"),
rr AS (SELECT *, CAST(least(greatest(sev * imp * m * CASE s WHEN 'internal' THEN 1.05 WHEN 'pii' THEN 1.15 WHEN 'regulated' THEN CASE WHEN st THEN 1.35 ELSE 1.25 END ELSE 1.0 END + p_tol + p_conf, 0), 1) AS DOUBLE) AS r, CASE WHEN s = 'regulated' AND st AND kind IN ('REMOVE', 'TYPE_CHANGE') THEN 0.80 ELSE 0.0 END AS floor FROM rj)"""


@R.query(f"""WITH RECURSIVE {_R} SELECT batch_id, kind, "column", CAST(p_tol AS DOUBLE) AS p_tol, round(CAST(p_conf AS DOUBLE), 6) AS p_conf, round(r, 6) AS r FROM rr""")
def risk_contributions(spark, sf_dir):
    p = _parts(spark, sf_dir)
    out = risk.contributions(p["final"], p["renames"], _config(spark), spark.createDataFrame(_FIELDS, _FIELD_SHAPE))
    return out.select("batch_id", "kind", "column", "p_tol", "p_conf", F.round("r", 6).alias("r"))


@R.query(f"""WITH RECURSIVE {_R}, k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY r DESC, kind, "column") AS pos FROM rr), u AS (SELECT batch_id, greatest(1 - product(1 - r), max(floor)) AS raw, string_agg(kind || ':' || "column", ',' ORDER BY pos) FILTER (pos <= 10) AS drivers FROM k GROUP BY 1),
z AS (SELECT b.dataset, b.batch_id, round(CAST(least(greatest(coalesce(raw, 0.0), 0), 1) AS DOUBLE), 6) AS risk, coalesce(drivers, '') AS drivers FROM b LEFT JOIN u USING (batch_id))
SELECT dataset, batch_id, risk, CASE WHEN risk >= 0.80 THEN 'high' WHEN risk >= 0.40 THEN 'medium' ELSE 'low' END AS level, CASE WHEN risk >= 0.40 THEN 'staging' ELSE 'production' END AS suggested_route, drivers, 'combined risk = ' || printf('%.3f', risk) AS reason FROM z""")
def risk_mode_b(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return risk.mode_b(p["facts"], risk.contributions(p["final"], p["renames"], _config(spark), spark.createDataFrame(_FIELDS, _FIELD_SHAPE)))


_SAID = """CASE kind WHEN 'RENAME' THEN "column" || ' -> ' || new || ': confidence ' || coalesce(printf('%.2f', confidence), '-') WHEN 'ADD' THEN 'new column ' || "column" || ' appeared' WHEN 'REMOVE' THEN 'column ' || "column" || ' is missing' WHEN 'TYPE_CHANGE' THEN 'type of ' || "column" || ' changed: ' || old || ' -> ' || new ELSE 'nullability of ' || "column" || ' changed: ' || old || ' -> ' || new END"""
_EXPLAINED = f"""{_ASSIGNED}, ex AS (SELECT f.*, CASE kind WHEN 'RENAME' THEN 1 WHEN 'ADD' THEN 2 WHEN 'REMOVE' THEN 3 WHEN 'TYPE_CHANGE' THEN 4 ELSE 5 END AS section, {_SAID} AS explanation FROM final f LEFT JOIN ren ON ren.batch_id = f.batch_id AND f.kind = 'RENAME' AND ren.old_name = f."column")"""


@R.query(f"""WITH RECURSIVE {_EXPLAINED} SELECT dataset, batch_id, kind, "column", old, new, explanation FROM ex""")
def drift_explanations(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return reports.explanations(p["final"], p["renames"]).select(*BATCH, "kind", "column", "old", "new", "explanation")


@R.query(f"""WITH RECURSIVE {_EXPLAINED}, s AS (SELECT batch_id, string_agg(' - ' || explanation, chr(10) ORDER BY section, "column") AS lines FROM ex GROUP BY 1), o AS (SELECT batch_id, string_agg("column", ', ' ORDER BY "column") AS cols FROM facts GROUP BY 1)
SELECT b.dataset, b.batch_id, 'batch ' || b.batch_id || chr(10) || 'columns: ' || cols || chr(10) || CASE WHEN lines IS NULL THEN 'no drift' ELSE 'drift:' || chr(10) || lines END AS summary FROM b JOIN o USING (batch_id) LEFT JOIN s USING (batch_id)""")
def drift_summaries(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return reports.batch_summary(p["facts"], reports.explanations(p["final"], p["renames"]))
