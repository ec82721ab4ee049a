"""Policy and protection: the method that a finding's sensitivity asks for, applied to values, texts and columns."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.operators import pii

# Scores of compliance demands, and when a method is due.
COMPLIANCE = {"none": 1, "internal": 2, "gdpr": 3, "hipaa": 5, "pci": 5}
METHODS = ("mask", "hash", "encrypt", "tokenize", "hash_password")


def compliance_score(c: Column) -> Column:
    out = F.lit(1)
    for k, v in COMPLIANCE.items():
        out = F.when(F.lower(F.trim(c)) == k, F.lit(v)).otherwise(out)
    return out


def token(c: Column, key: str) -> Column:
    """A keyed token of 128 bits: the same for equal values, no two values alike in practice."""
    return F.concat(F.lit("TKN_"), F.left(F.sha2(F.concat(F.lit(key), c), 256), F.lit(32)))


def password_hash(c: Column, salt: str, rounds: int = 10_000) -> Column:
    """PBKDF2-HMAC-SHA256 in hex; a null costs nothing."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.pbkdf2_hmac("sha256", v.encode(), salt.encode(), rounds).hex())

    return run(c)


def protected(value: Column, method: Column, salt: str, key: str, cipher: Column | None = None) -> Column:
    """A value under its method; salt and keys come from configuration.  cipher: what stands for `encrypt`, by default AES-GCM."""
    return (
        F.when(method == "mask", pii.mask(value))
        .when(method == "hash", pii.salted_hash(value, salt))
        .when(method == "encrypt", pii.encrypt(value, key) if cipher is None else cipher)
        .when(method == "tokenize", token(value, key))
        .when(method == "hash_password", password_hash(F.when(method == "hash_password", value), salt))
        .otherwise(value)
    )


def chosen(found: DataFrame, policies: DataFrame, compliance: Column) -> DataFrame:
    """Findings with sensitivity_level, risk_score and method."""
    out = pii.with_sensitivity(found, policies).withColumn("risk_score", pii.risk_score(F.col("sensitivity_level"), compliance_score(compliance)))
    return out.withColumn("method", pii.method(F.col("entity"), F.col("risk_score")))


def log(found: DataFrame, id_col: str, salt: str, key: str, cipher: Column | None = None) -> DataFrame:
    """(id_col, entity, start, end, method, protected): a row a finding."""
    return found.select(id_col, "entity", "start", "end", "method", protected(F.col("value"), F.col("method"), salt, key, cipher).alias("protected"))


def redact_texts(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, salt: str, key: str, cipher: Column | None = None) -> DataFrame:
    """(id_col, text, n_protected) of every document: each found value replaced, the longest first; texts without findings stay."""
    safe = protected(F.col("value"), F.col("method"), salt, key, cipher)
    by_doc = found.groupBy(id_col).agg(F.collect_set(F.struct("value", safe.alias("safe"))).alias("r"), F.count("*").alias("n"))
    joined = docs.select(id_col, text_col).join(by_doc, id_col, "left")
    return joined.select(id_col, F.when(F.col("r").isNull(), F.col(text_col)).otherwise(pii.redact(F.col(text_col), F.col("r"))).alias("text"), F.coalesce("n", F.lit(0)).alias("n_protected"))


def protect_columns(df: DataFrame, methods: dict[str, str], salt: str, key: str) -> DataFrame:
    """Columns under their methods; other columns stay."""
    return df.withColumns({c: protected(F.col(c).cast("string"), F.lit(m), salt, key) for c, m in methods.items()})


def policy_report(policies: DataFrame) -> DataFrame:
    """Policies as a readable table, strictest first."""
    rank = F.array_position(F.array(*(F.lit(x) for x in ("Low", "Medium", "High", "Critical"))), F.col("sensitivity_level"))
    return policies.select(F.upper("entity").alias("Entity"), F.col("sensitivity_level").alias("Sensitivity"), F.coalesce("regulation", F.lit("-")).alias("Regulation"), F.coalesce("reason", F.lit("")).alias("Reason"), rank.cast("int").alias("Rank"))


def statistics(found: DataFrame, id_col: str) -> DataFrame:
    """One row: findings, kinds, findings of high sensitivity, documents with any."""
    return found.agg(F.count("*").alias("total"), F.count_distinct("entity").alias("kinds"), F.count_if(F.col("sensitivity_level").isin("High", "Critical")).alias("high"), F.count_distinct(id_col).alias("documents"))
