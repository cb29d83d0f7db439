"""Every registered query against its SQL counterpart."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from workload.oracles import all_oracles
from workload.queries import all_queries

FOLDER = os.environ.get("OPINARA_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def ordered(rows, columns):
    by_name = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in by_name) for row in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_sql():
    assert set(all_oracles()) == set(all_queries())
    assert set(all_queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, sql, name):
    df = contract.queries()[name](spark, FOLDER)
    cursor = sql.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(cursor.fetchall(), columns)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:3] == ["business_id", "business_name", "city_name"]
    assert df.count() == 10
