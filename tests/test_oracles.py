"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from lanternlake import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return "NULL" if value != value else repr(value)
    return "NULL" if value is None else str(value)


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, database, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted("|".join(shown(r[c]) for c in columns) for r in df.collect())
    found = database.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    rows = found.fetchall()
    assert sorted(names) == columns
    assert got == sorted("|".join(shown(r[names.index(c)]) for c in columns) for r in rows)
    spark.catalog.clearCache()


def test_other_queries_run(spark):
    for name in ("rule_boost", "voice_fixes", "json_fail_closed", "ocr_date_repair", "procedural_overview", "query_identifiers"):
        assert catalogue.QUERIES[name](spark, FOLDER).count() > 0
    assert catalogue.entry(spark, FOLDER).count() > 0
