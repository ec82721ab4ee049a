"""Queries of protection, dates, labels and text gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.operators import pii, protect, text
from tabwarden.plans.register import Registry, table

R = Registry()

SALT, KEY = "pepper", "0123456789abcdef"
_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_POLICIES = (("email", "Medium", "contact", "GDPR"), ("EMAIL", "Low", None, None), ("ACCOUNT", "Critical", "money", "PCI"), ("NAME", "High", "person", None), ("PASSWORD", "High", None, "GDPR"), ("SEGMENT", "Low", "group", None))


def _policies(spark) -> DataFrame:
    return spark.createDataFrame(_POLICIES, "entity string, sensitivity_level string, reason string, regulation string")


# findings: three columns of each customer
_FOUND = """f AS (SELECT c_custkey, 'NAME' AS entity, c_name AS value, 'gdpr' AS demand FROM customer UNION ALL SELECT c_custkey, 'ACCOUNT', printf('%.2f', c_acctbal), 'pci' FROM customer UNION ALL SELECT c_custkey, 'SEGMENT', c_mktsegment, 'none' FROM customer UNION ALL SELECT c_custkey, 'OTHER', c_mktsegment || '!', 'hipaa' FROM customer UNION ALL SELECT c_custkey, 'email', 'u' || c_custkey || '@x.org', 'internal' FROM customer),
l AS (SELECT *, CASE entity WHEN 'NAME' THEN 'High' WHEN 'ACCOUNT' THEN 'Critical' WHEN 'SEGMENT' THEN 'Low' WHEN 'email' THEN 'Medium' ELSE 'Unknown' END AS sensitivity_level FROM f),
s AS (SELECT *, round(0.7 * CASE sensitivity_level WHEN 'High' THEN 5 WHEN 'Critical' THEN 5 WHEN 'Medium' THEN 3 ELSE 1 END + 0.3 * CASE demand WHEN 'gdpr' THEN 3 WHEN 'pci' THEN 5 WHEN 'hipaa' THEN 5 WHEN 'internal' THEN 2 ELSE 1 END, 4) AS risk_score FROM l),
m AS (SELECT *, CASE WHEN risk_score <= 2 THEN 'mask' WHEN risk_score <= 3.5 THEN 'hash' WHEN risk_score <= 4.5 THEN 'encrypt' ELSE 'tokenize' END AS method FROM s),
p AS (SELECT *, CASE method WHEN 'mask' THEN CASE WHEN len(value) <= 4 THEN repeat('*', len(value)) ELSE value[1:2] || repeat('*', len(value) - 4) || value[-2:] END WHEN 'hash' THEN sha256('pepper' || value) WHEN 'encrypt' THEN '<' || value || '>' ELSE 'TKN_' || sha256('0123456789abcdef' || value)[1:32] END AS protected FROM m)"""


def _found(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "customer")
    kinds = (("NAME", F.col("c_name"), "gdpr"), ("ACCOUNT", F.format_string("%.2f", "c_acctbal"), "pci"), ("SEGMENT", F.col("c_mktsegment"), "none"), ("OTHER", F.concat("c_mktsegment", F.lit("!")), "hipaa"), ("email", F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@x.org")), "internal"))
    each = t.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(e).alias("entity"), v.alias("value"), F.lit(d).alias("demand"), F.lit(0).alias("start"), F.length(v).alias("end")) for e, v, d in kinds))).alias("x")).select("c_custkey", "x.*")
    return protect.chosen(each, _policies(spark), F.col("demand"))


@R.query(f"WITH {_FOUND} SELECT c_custkey, entity, sensitivity_level, CAST(risk_score AS DOUBLE) AS risk_score, method, protected FROM p")
def protection_log(spark, sf_dir):
    """Every finding with its method and what it becomes; encrypted values are shown opened, between marks."""
    found = _found(spark, sf_dir)
    opened = F.concat(F.lit("<"), pii.decrypt(pii.encrypt(F.col("value"), KEY), KEY), F.lit(">"))
    logged = protect.log(found, "c_custkey", SALT, KEY, opened)
    return logged.join(found.select("c_custkey", "entity", "sensitivity_level", "risk_score"), ["c_custkey", "entity"]).select("c_custkey", "entity", "sensitivity_level", "risk_score", "method", "protected")


@R.query(f"WITH {_FOUND} SELECT count(*) AS total, count(DISTINCT entity) AS kinds, count(*) FILTER (sensitivity_level IN ('High', 'Critical')) AS high, count(DISTINCT c_custkey) AS documents FROM l")
def protection_statistics(spark, sf_dir):
    return protect.statistics(_found(spark, sf_dir), "c_custkey")


@R.query("SELECT c_custkey, 'Dear ' || 'TKN_' || sha256('0123456789abcdef' || c_name)[1:32] || ', you are in ' || CASE WHEN len(c_mktsegment) <= 4 THEN repeat('*', len(c_mktsegment)) ELSE c_mktsegment[1:2] || repeat('*', len(c_mktsegment) - 4) || c_mktsegment[-2:] END || '; ' || CASE WHEN len(c_mktsegment) <= 4 THEN repeat('*', len(c_mktsegment)) ELSE c_mktsegment[1:2] || repeat('*', len(c_mktsegment) - 4) || c_mktsegment[-2:] END || '.' AS text, 2 AS n_protected FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'Dear ' || c_name || ', you are in ' || c_mktsegment || '; ' || c_mktsegment || '.', 0 FROM customer WHERE c_custkey % 4 = 0")
def texts_protected(spark, sf_dir):
    """Letters with the values that were found in them replaced, all occurrences; letters without findings stay."""
    t = table(spark, sf_dir, "customer")
    letters = t.select("c_custkey", F.concat(F.lit("Dear "), "c_name", F.lit(", you are in "), "c_mktsegment", F.lit("; "), "c_mktsegment", F.lit(".")).alias("text"))
    found = t.where("c_custkey % 4 <> 0").select("c_custkey", F.explode(F.array(F.struct(F.col("c_name").alias("value"), F.lit("tokenize").alias("method")), F.struct(F.col("c_mktsegment").alias("value"), F.lit("mask").alias("method")))).alias("x")).select("c_custkey", "x.*")
    return protect.redact_texts(letters, found, "c_custkey", "text", SALT, KEY)


@R.query("SELECT s_suppkey, sha256('pepper' || s_name) AS s_name, CASE WHEN len(CAST(s_nationkey AS VARCHAR)) <= 4 THEN repeat('*', len(CAST(s_nationkey AS VARCHAR))) END AS s_nationkey, s_acctbal FROM supplier")
def columns_protected(spark, sf_dir):
    return protect.protect_columns(table(spark, sf_dir, "supplier"), {"s_name": "hash", "s_nationkey": "mask"}, SALT, KEY).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@R.query(
    """SELECT r_name || '_' || e AS "Entity", l AS "Sensitivity", coalesce(g, '-') AS "Regulation", coalesce(w, '') AS "Reason", CASE l WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END AS "Rank" FROM region, (VALUES """
    + ", ".join("('" + e.upper() + "', '" + lv + "', " + (f"'{w}'" if w else "NULL") + ", " + (f"'{g}'" if g else "NULL") + ")" for e, lv, w, g in _POLICIES)
    + ") v(e, l, w, g)"
)
def policy_report(spark, sf_dir):
    """Each region's policies."""
    p = table(spark, sf_dir, "region").join(_policies(spark))  # five regions
    return protect.policy_report(p.withColumn("entity", F.concat("r_name", F.lit("_"), F.upper("entity"))))


@R.query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders WHERE true")
def pii_month_first_dates(spark, sf_dir):
    """Dates as `March 7, 1995`, found in a sentence and brought to one form."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("paid on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(".")).alias("t"))
    spans = pii.detect(F.col("t"), tuple(d for d in pii.DETECTORS if d.entity == "DATE"))
    return t.select("o_orderkey", pii.to_iso(spans[0]["value"]).alias("iso"))


@R.query("SELECT s_suppkey, 'at ' || printf('2001:db8::%x', s_suppkey) || ' and ' || printf('fe80:0:0:0:%x:1:2:3', s_suppkey) || ' not 1::2::3' AS text, printf('2001:db8::%x', s_suppkey) AS first, printf('fe80:0:0:0:%x:1:2:3', s_suppkey) AS second, 2 AS n FROM supplier")
def pii_ipv6(spark, sf_dir):
    key = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("at "), F.format_string("2001:db8::%x", key), F.lit(" and "), F.format_string("fe80:0:0:0:%x:1:2:3", key), F.lit(" not 1::2::3")).alias("text"))
    spans = pii.detect(F.col("text"), pii.IPV6)
    return t.select("s_suppkey", "text", spans[0]["value"].alias("first"), spans[1]["value"].alias("second"), F.size(spans).alias("n"))


@R.query("SELECT c_custkey, entity FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'PER' WHEN 1 THEN 'O' ELSE 'IP_ADDRESS' END AS entity, (c_custkey % 10) / 10.0 AS confidence FROM customer) WHERE entity <> 'O' AND confidence >= 0.6")
def labels_filtered(spark, sf_dir):
    k = F.col("c_custkey")
    label = F.when(k % 3 == 0, "Person").when(k % 3 == 1, "O").otherwise("ip_address_v6")
    labels = table(spark, sf_dir, "customer").select("c_custkey", label.alias("entity"), (k % 10 / 10).alias("confidence"))
    return pii.confident(labels).select("c_custkey", "entity")


@R.query(r"SELECT page_id, regexp_matches(html, '<[^\n]*?>') AS has_tags, html <> (CASE WHEN regexp_matches(html, '<[^\n]*?>') THEN trim(regexp_replace(regexp_replace(html, '<[^\n]*?>', '', 'g'), '[ \t\r\n\f]+', ' ', 'g')) ELSE html END) AS changed, CAST(CASE WHEN NOT regexp_matches(html, '<[^\n]*?>') THEN 1.0 ELSE CASE WHEN html <> trim(regexp_replace(regexp_replace(html, '<[^\n]*?>', '', 'g'), '[ \t\r\n\f]+', ' ', 'g')) THEN 0.95 ELSE 0.8 END END AS DOUBLE) AS confidence FROM pages")
def html_confidence(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").rlike(text.TAG).alias("has_tags"), text.html_changed(F.col("html")).alias("changed"), text.html_confidence(F.col("html")).alias("confidence"))


_WORDS = "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang = 'en'), d AS (SELECT word FROM w GROUP BY word HAVING count(DISTINCT doc_id) >= 20)"


@R.query(f"WITH {_WORDS}, n AS (SELECT doc_id, count(*) AS k, count(*) FILTER (d.word IS NULL) AS u FROM w LEFT JOIN d USING (word) GROUP BY 1) SELECT x.doc_id, coalesce(lang = 'en', false) AND coalesce(k, 0) >= 2 AND coalesce(u / k, 0) >= 0.1 AS corrects FROM documents x LEFT JOIN n USING (doc_id)")
def spell_gate(spark, sf_dir):
    """Which documents are worth correcting: English, two words, a tenth of them unknown."""
    docs = table(spark, sf_dir, "documents")
    english = docs.where("lang = 'en'")
    noisy = text.noise(english, "doc_id", "text", text.dictionary(english, "doc_id", "text", 20))
    return text.spell_gate(docs.join(noisy, "doc_id", "left")).select("doc_id", "corrects")


@R.query(r"SELECT conv_id, turn, role, text, regexp_matches(text, '[A-Za-z]') AND len(list_filter(string_split_regex(trim(text), '[ \t\r\n\f]+'), lambda x: x <> '')) >= 3 AS scans, CASE WHEN regexp_matches(text, '[A-Za-z]') AND len(list_filter(string_split_regex(trim(text), '[ \t\r\n\f]+'), lambda x: x <> '')) >= 3 THEN len(regexp_extract_all(lower(text), '(?:^|[^a-z])(the|and)')) ELSE 0 END AS n_found FROM conversations")
def entity_gate(spark, sf_dir):
    """Turns that are scanned for names of a table, and how many it finds."""
    names = spark.createDataFrame([("the", "FUNCTION"), ("and", "FUNCTION")], "name string, entity string")
    t = table(spark, sf_dir, "conversations")
    ok = text.entity_gate(F.col("text"), F.lit("en")) & F.col("text").rlike("[A-Za-z]")
    return t.select("conv_id", "turn", "role", "text", ok.alias("scans"), F.when(ok, text.name_counts(F.col("text"), [r["name"] for r in names.collect()])).otherwise(0).alias("n_found"))


@R.query(r"SELECT doc_id, coalesce(source, 'unknown') AS source, doc_id || '_0' AS first_chunk, n_chars > 0 AS has_text FROM documents WHERE text IS NOT NULL AND trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')) <> ''")
def chunk_sources(spark, sf_dir):
    """The first chunk of each text with its source."""
    docs = table(spark, sf_dir, "documents").withColumn("page", F.lit(1))
    c = text.chunks(docs, "doc_id", "text", keep=("source", "page", "n_chars")).where("chunk_no = 0")
    return c.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.col("chunk_id").alias("first_chunk"), (F.col("n_chars") > 0).alias("has_text"))


@R.query(r"""SELECT conv_id, turn, role, text AS raw, CASE WHEN regexp_matches(text, '<[^\n]*?>') THEN trim(regexp_replace(regexp_replace(text, '<[^\n]*?>', '', 'g'), '[ \t\r\n\f]+', ' ', 'g')) ELSE text END AS clean_text, CASE WHEN text IS NULL OR trim(text) = '' THEN 'failed' WHEN NOT regexp_matches(text, '\p{L}') OR len(text) < 3 THEN 'partial' ELSE 'cleaned' END AS status FROM conversations""")
def text_pipeline_status(spark, sf_dir):
    out = text.run_plan(table(spark, sf_dir, "conversations").withColumn("raw", F.col("text")), "text")
    return out.select("conv_id", "turn", "role", "raw", "clean_text", "status")
