"""Every registered query of this part against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tabwarden.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    res = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(res.columns) == cols
    at = [res.columns.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in res.fetchall())


#: Queries that SQL can't express, and the tests that hold them against plain Python.
ELSEWHERE = {
    "test_more.py": {"match_learned"},
    "test_whole.py": {"spell_correct_all"},
    "test_spans.py": {"pii_resolved", "pii_statistics", "redact_text"},
    "test_learned.py": {"impute_forest", "impute_columns", "impute_explained"},
    "test_texts.py": {"sentences_learned", "text_chain"},
    "test_plain.py": {"dependency_table", "lang_detect", "chunks", "chunks_overlap"},
}


def test_every_query_is_held():
    named = set().union(*ELSEWHERE.values())
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == named
    for name, queries in ELSEWHERE.items():
        with open(f"{os.path.dirname(__file__)}/{name}") as f:
            text = f.read()
        assert all(q in text for q in queries)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
