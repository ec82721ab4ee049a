"""Queries that take all rows, where others take those that their SQL names."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tabwarden.plans import catalog

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_spelling_of_all_words(spark):
    df = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select(F.lower("text").alias("t")).collect():
        df.update(set(re.findall("[a-z]+", r["t"] or "")))
    known = {w: n for w, n in df.items() if n >= 20}
    got = {r["word"]: r["best"] for r in catalog.QUERIES["spell_correct_all"](spark, SF).collect()}
    unknown = sorted(set(df) - set(known))
    assert set(got) <= set(unknown) and any(df[w] < 15 for w in got)
    some = unknown[::5]
    for w in some:
        near = [(d, -n, k) for k, n in known.items() if abs(len(k) - len(w)) <= 2 and (d := distance(w, k)) <= 2]
        assert got.get(w) == (min(near)[2] if near else None)


def test_number_of_every_customer(spark, tmp_path):
    whole = f"{tmp_path}/customer.parquet"
    spark.range(9990, 10020).select(F.col("id").alias("c_custkey")).unionByName(spark.range(123456, 123460).select(F.col("id").alias("c_custkey"))).coalesce(1).write.parquet(whole)
    got = {r["c_custkey"]: r["n_nic"] for r in catalog.QUERIES["pii_nic_all"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{whole}/*.parquet'")
    assert len(got) == 34 and got == dict(duck.sql(catalog.ORACLE_SQL["pii_nic_all"]).fetchall())
