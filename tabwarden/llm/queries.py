"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.llm import bm25, decontaminate, divergence, language_id, license_scan, mixing, near_dup, ppm, quality, secrets, token_counts, token_output, whitening
from tabwarden.llm.tables import held_out, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
COUNTING_VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def op1_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, ~held_out("doc_id", 4))
    return found.select("doc_id", held_out("doc_id", 4).alias("held_out"), F.col("lang_nearest").alias("lang_pred"), "score", "rejected")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("matches")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7))
    return scored.select("doc_id", held_out("doc_id", 7).alias("held_out"), *scored.columns[1:])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_ID)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTING_VOCABULARY))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "n_chunks")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_top_k_search,
        op2_language_id,
        op3_license_scan,
        op4_benchmark_decontamination,
        op5_lm_scoring,
        op6_source_mixing,
        op7_quality_classifier,
        op8_secret_scan,
        op9_minhash_near_dedup,
        op10_token_output,
        op11_token_counts,
        op12_source_divergence,
        op13_embedding_whitening,
    )
}

_TERM_COUNTS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0)::HUGEINT AS total FROM grp g LEFT JOIN n USING (lang, source) GROUP BY ALL),
kinds AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 1) // (t.total + s.v) AS p
  FROM grp g JOIN kept k USING (lang) JOIN total t USING (lang, source) JOIN kinds s USING (lang) LEFT JOIN n USING (lang, source, term)),
lang_n AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v)::HUGEINT AS q FROM lang_n JOIN kinds USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
own AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM own)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""

#: The others learn, hash, link or tokenize; they are held against brute-force versions in tests/llm.
ORACLE_SQL: dict[str, str] = {"op12_source_divergence": _TERM_COUNTS}
