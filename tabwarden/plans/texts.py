"""Queries of privacy, text and retrieval operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwarden.operators import pii, protect, text
from tabwarden.operators import sentences as boundaries
from tabwarden.plans.register import Registry, table

R = Registry()


def _found(spark, sf_dir, entity: str) -> DataFrame:
    detectors = tuple(d for d in pii.DETECTORS if d.entity == entity and d not in pii.IPV6)
    return pii.entities(table(spark, sf_dir, "documents"), "doc_id", "text", detectors, resolved=False)


def _values(pattern: str, where: str, entity: str, extra: str = "") -> str:
    return f"WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM documents) SELECT doc_id, '{entity}' AS entity, value{extra} FROM v WHERE {where}"


@R.query(_values(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "true", "EMAIL"))
def pii_email(spark, sf_dir):
    return _found(spark, sf_dir, "EMAIL").select("doc_id", "entity", "value")


@R.query(_values(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "len(list_filter(string_split(value, '.'), lambda x: CAST(x AS INT) > 255 OR regexp_matches(x, '^0\\d'))) = 0", "IP_ADDRESS"))
def pii_ipv4(spark, sf_dir):
    return _found(spark, sf_dir, "IP_ADDRESS").select("doc_id", "entity", "value")


_LUHN = "list_sum(list_transform(range(1, len(value) + 1), lambda i: CASE WHEN (len(value) - i) % 2 = 1 THEN (CASE WHEN 2 * CAST(value[i] AS INT) > 9 THEN 2 * CAST(value[i] AS INT) - 9 ELSE 2 * CAST(value[i] AS INT) END) ELSE CAST(value[i] AS INT) END)) % 10 = 0"


@R.query(_values(r"\b\d{13,19}\b", r"(regexp_matches(value, '^4(\d{12}|\d{15}|\d{18})$') OR regexp_matches(value, '^5[1-5]\d{14}$') OR regexp_matches(value, '^3[47]\d{13}$') OR regexp_matches(value, '^6(011|5)\d+$')) AND " + _LUHN, "CREDIT_CARD"))
def pii_credit_card(spark, sf_dir):
    return _found(spark, sf_dir, "CREDIT_CARD").select("doc_id", "entity", "value")


@R.query(_values(r"\b\d{10,18}\b", "len(value) IN (11, 12, 13, 14, 15, 16, 18)", "BANK_ACCOUNT", ", CAST(CASE WHEN regexp_matches(value, '^(01|10|18|88|2042|1|2)') THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence"))
def pii_bank(spark, sf_dir):
    return _found(spark, sf_dir, "BANK_ACCOUNT").select("doc_id", "entity", "value", "confidence")


@R.query(
    r"""WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\+94|0)[\s\-]*\d{2}(?:[\s\-]*\d{3,4}){2}')) AS value FROM documents), d AS (SELECT *, regexp_replace(value, '\D', '', 'g') AS d FROM v),
l AS (SELECT *, CASE WHEN starts_with(d, '94') THEN '0' || substr(d, 3) ELSE d END AS l FROM d) SELECT doc_id, 'PHONE_NUMBER' AS entity, value FROM l WHERE len(l) = 10 AND l[1:3] IN ("""
    + ", ".join(f"'{c}'" for c in pii.MOBILE_CODES + pii.LANDLINE_CODES)
    + ")"
)
def pii_phone(spark, sf_dir):
    return _found(spark, sf_dir, "PHONE_NUMBER").select("doc_id", "entity", "value")


@R.query(
    """WITH c AS (SELECT c_custkey, printf('%02d', c_custkey % 60 + 40) || printf('%03d', c_custkey * 7 % 900) || printf('%04d', c_custkey % 10000) || 'V' AS nic FROM customer)
SELECT c_custkey, CASE WHEN CAST(nic[3:5] AS INT) BETWEEN 1 AND 366 OR CAST(nic[3:5] AS INT) BETWEEN 501 AND 866 THEN 1 ELSE 0 END AS n_nic FROM c"""
)
def pii_nic_all(spark, sf_dir):
    """A number for every customer."""
    key = F.col("c_custkey")
    nic = F.concat(F.format_string("%02d", key % 60 + 40), F.format_string("%03d", key * 7 % 900), F.format_string("%04d", key % 10000), F.lit("V"))
    t = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("holder "), nic, F.lit(".")).alias("t"))
    return t.select("c_custkey", F.size(pii.detect(F.col("t"), tuple(d for d in pii.DETECTORS if d.entity == "NIC"))).alias("n_nic"))


@R.query(
    """SELECT s_suppkey, 'seen 02:1a:' || printf('%02x', s_suppkey % 256) || ':0b:0c:0d' AS text, 'LAA' AS mac_class, 11 + 6 - 12 AS start FROM supplier"""
)
def pii_mac(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("seen 02:1a:"), F.format_string("%02x", F.col("s_suppkey") % 256), F.lit(":0b:0c:0d")).alias("text"))
    spans = pii.detect(F.col("text"), tuple(d for d in pii.DETECTORS if d.entity == "MAC_ADDRESS"))
    return t.withColumn("s", F.explode(spans)).select("s_suppkey", "text", pii.mac_class(F.col("s.value")).alias("mac_class"), F.col("s.start").alias("start"))


@R.query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS iso_short, 1 AS n FROM orders")
def pii_dates(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("d"), F.date_format("o_orderdate", "d-M-yy").alias("s"))
    n = F.size(pii.detect(F.concat(F.lit("due on "), "d", F.lit(" at noon")), tuple(d for d in pii.DETECTORS if d.entity == "DATE")))
    return t.select("o_orderkey", pii.to_iso(F.col("d")).alias("iso"), pii.to_iso(F.col("s")).alias("iso_short"), n.alias("n"))


def _entities(spark, sf_dir) -> DataFrame:
    return pii.entities(table(spark, sf_dir, "documents"), "doc_id", "text")


@R.query()
def pii_resolved(spark, sf_dir):
    return _entities(spark, sf_dir)


POLICIES = (("NIC", "High"), ("CREDIT_CARD", "Critical"), ("BANK_ACCOUNT", "High"), ("PHONE_NUMBER", "Medium"), ("IP_ADDRESS", "Medium"), ("EMAIL", "Medium"), ("DATE", "Low"), ("EMAIL", "Low"))


def _protected(spark, sf_dir) -> DataFrame:
    policies = spark.createDataFrame(POLICIES, "entity string, sensitivity_level string")
    return protect.chosen(_entities(spark, sf_dir), policies, F.lit("gdpr"))


@R.query()
def pii_statistics(spark, sf_dir):
    """Counts of findings by entity, sensitivity and chosen method."""
    return _protected(spark, sf_dir).groupBy("entity", "sensitivity_level", "method").agg(F.count("*").alias("n"))


@R.query()
def redact_text(spark, sf_dir):
    """Every document, each found value replaced by what its method makes of it; hashes stand for ciphers, which differ from run to run."""
    found = _protected(spark, sf_dir)
    return protect.redact_texts(table(spark, sf_dir, "documents"), found, "doc_id", "text", "salt", "0123456789abcdef", pii.salted_hash(F.col("value"), "cipher"))


@R.query("SELECT c_custkey, CASE WHEN len(c_name) <= 4 THEN repeat('*', len(c_name)) ELSE c_name[1:2] || repeat('*', len(c_name) - 4) || c_name[-2:] END AS masked, sha256('pepper' || c_name) AS hashed FROM customer")
def protect_mask_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", pii.mask(F.col("c_name")).alias("masked"), pii.salted_hash(F.col("c_name"), "pepper").alias("hashed"))


@R.query("SELECT c_custkey, c_name AS opened FROM customer")
def protect_aes_roundtrip(spark, sf_dir):
    key = "0123456789abcdef"
    return table(spark, sf_dir, "customer").select("c_custkey", pii.decrypt(pii.encrypt(F.col("c_name"), key), key).alias("opened"))


@R.query("SELECT c_custkey, 'TKN_' || sha256('key' || c_mktsegment)[1:32] AS token, c_mktsegment AS opened FROM customer")
def tokenize_roundtrip(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    vault = pii.tokenize(t, "c_mktsegment", "key")
    hidden = t.join(vault, t["c_mktsegment"] == vault["value"]).select("c_custkey", "token")
    return hidden.join(vault, "token").select("c_custkey", "token", F.col("value").alias("opened"))


@R.query("SELECT o_orderkey, year(o_orderdate) AS year, o_orderpriority AS place FROM orders")
def generalize(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return t.select("o_orderkey", F.year("o_orderdate").alias("year"), pii.generalize_place(F.concat(F.lit("a, b, "), "o_orderpriority")).alias("place"))


@R.query(
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, text AS token, turn % 3 AS k FROM conversations),
l AS (SELECT *, CASE k WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' ELSE 'O' END AS label, lag(k) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM t), r AS (SELECT *, sum(CASE WHEN k = 0 OR (k = 1 AND coalesce(before, 2) = 2) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM l)
SELECT conv_id AS doc_id, 'PER' AS entity, string_agg(token, ' ' ORDER BY pos) AS value, min(pos) AS start_pos, max(pos) AS end_pos FROM r WHERE label <> 'O' GROUP BY conv_id, run"""
)
def bio_spans(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    label = F.when(F.col("turn") % 3 == 0, "B-PER").when(F.col("turn") % 3 == 1, "I-PER").otherwise("O")
    tokens = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), place.cast("long").alias("pos"), F.col("text").alias("token"), label.alias("label"))
    return pii.bio_spans(tokens).select("doc_id", "entity", "value", "start_pos", "end_pos")


@R.query(r"SELECT page_id, CASE WHEN regexp_matches(html, '<[^\n]*?>') THEN trim(regexp_replace(regexp_replace(html, '<[^\n]*?>', '', 'g'), '[ \t\r\n\f]+', ' ', 'g')) ELSE html END AS text FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@R.query(r"SELECT doc_id, CASE WHEN len(text) < 2 THEN 0 ELSE len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) END AS n_tokens FROM documents")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@R.query(
    r"""SELECT doc_id, CASE WHEN len(text) < 5 THEN 1 ELSE len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\r\n\f]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) END AS n_sentences FROM documents"""
)
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


_WORDS = "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang = 'en')"
_DICT = "d AS (SELECT word, count(DISTINCT doc_id) AS n FROM w GROUP BY word HAVING count(DISTINCT doc_id) >= 20)"


def _english(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return docs, text.dictionary(docs, "doc_id", "text", 20)


@R.query(f"WITH {_WORDS}, {_DICT} SELECT doc_id, count(*) AS n_words, CAST(count(*) FILTER (d.word IS NULL) AS BIGINT) AS n_unknown, round(count(*) FILTER (d.word IS NULL) / count(*), 6) AS ratio FROM w LEFT JOIN d USING (word) GROUP BY doc_id")
def spell_noise(spark, sf_dir):
    docs, known = _english(spark, sf_dir)
    return text.noise(docs, "doc_id", "text", known)


@R.query()
def spell_correct_all(spark, sf_dir):
    """Every English word that the dictionary lacks, by up to two edits; tests/test_whole.py holds it against brute force."""
    docs, known = _english(spark, sf_dir)
    unknown = text.words(docs, "doc_id", "text").select("word").distinct().join(known, "word", "left_anti")
    return text.corrections(unknown, known, 2)


@R.query(
    r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents WHERE lang IS NOT NULL), k AS (SELECT lang, '_' || w || '_' AS w, count(*) AS k FROM w GROUP BY ALL),
g AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: w[i:i+2])) AS gram FROM k) SELECT lang, gram, CAST(sum(k) AS BIGINT) AS n FROM g GROUP BY ALL"""
)
def lang_profile(spark, sf_dir):
    return text.language_profile(table(spark, sf_dir, "documents"), "text", "lang")


@R.query()
def lang_detect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return text.detect_language(docs.select("doc_id", "text"), "doc_id", "text", text.language_profile(docs, "text", "lang"))


@R.query(
    r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '<[^\n]*?>') THEN 'html_strip' END, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'language' END, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'spelling' END,
 CASE WHEN regexp_matches(text, '[.!?]') THEN 'sentences' END, 'tokens', CASE WHEN regexp_matches(text, '[A-Z][a-z]+ [A-Z][a-z]+|@') THEN 'entities' END, 'validation') AS steps FROM documents"""
)
def step_plan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.ordered_plan(text.plan(F.col("text"))), ",").alias("steps"))


@R.query(
    """SELECT conv_id, turn, role, text, concat_ws(',', CASE WHEN turn % 5 = 0 THEN 'bad confidence' END, CASE WHEN role = 'system' THEN 'bad status' END) AS errors, turn % 5 <> 0 AND role <> 'system' AS is_valid FROM conversations"""
)
def validate_records(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("confidence", F.when(F.col("turn") % 5 == 0, 1.5).otherwise(0.5)).withColumn("status", F.when(F.col("role") == "system", "Passed").otherwise("cleaned"))
    return text.validate(t, ("conv_id", "role"), "confidence", "status").select("conv_id", "turn", "role", "text", F.array_join("errors", ",").alias("errors"), "is_valid")


@R.query(r"WITH c AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '<[^\n]*?>') THEN trim(regexp_replace(regexp_replace(text, '<[^\n]*?>', '', 'g'), '[ \t\r\n\f]+', ' ', 'g')) ELSE text END AS clean_text FROM conversations) SELECT *, CASE WHEN len(clean_text) < 2 THEN 0 ELSE len(regexp_extract_all(clean_text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) END AS n_tokens FROM c")
def text_pipeline(spark, sf_dir):
    return text.run_plan(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "clean_text", F.size("tokens").cast("long").alias("n_tokens"))


@R.query()
def chunks(spark, sf_dir):
    return text.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@R.query()
def chunks_overlap(spark, sf_dir):
    return text.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", overlap=100)


@R.query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))) AS d FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) SELECT query_id, vec_id, round(d, 4) AS distance, rank FROM r WHERE rank <= 5"""
)
def retrieve_top5(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    q = t.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return text.nearest(q, t.select("vec_id", "embedding")).withColumn("distance", F.round("distance", 4))


@R.query()
def sentences_learned(spark, sf_dir):
    """Sentences of every document, with abbreviations learned from all of them."""
    docs = table(spark, sf_dir, "documents")
    return boundaries.split(docs, "text", boundaries.learn(docs, "text")).select("doc_id", "sentences")


@R.query()
def text_chain(spark, sf_dir):
    """Every turn of the conversations through all the steps of its plan; dictionary, languages and sentences are learned from the documents."""
    docs, known = _english(spark, sf_dir)
    whole = table(spark, sf_dir, "documents")
    out = text.run_chain(table(spark, sf_dir, "conversations"), "text", known, text.language_profile(whole, "text", "lang"), boundaries.learn(whole, "text"))
    return out.withColumns({c: F.array_join(c, "|") for c in ("sentences", "tokens", "entities", "steps", "steps_run", "errors")})
