"""The driver contract: every query has SQL, and a choice of them agrees on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from hedgerow.checks import queries as own
from verify import TABLES, rows_of

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()
CHOICE = [
    "s2_decode", "p12_likely_real", "m1_j2_rule_matcher", "m2_m3_category_matcher", "x9_page_secret_findings",
    "w10_crawl_rows", "a25_framework_scan", "b2_category_counts", "f5_o2_finding_ids", "k3_csv",
]


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert own.QUERIES.keys() == own.ORACLE.keys()
    assert own.QUERIES.keys() <= QUERIES.keys() and ORACLE.keys() <= QUERIES.keys()


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["site", "endpoint"] and rows.count() > 0


@pytest.mark.parametrize("name", CHOICE)
def test_query_agrees_with_sql(spark, db, sf, name):
    frame = QUERIES[name](spark, sf)
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    mine = rows_of(frame.columns, frame.collect())
    assert mine and mine == rows_of(columns, result.fetchall())
