"""Queries that SQL can express, against SQL on the smallest test tables."""

import os
from collections import Counter

import duckdb
import pytest

from opinara.llm import queries, sql

FOLDER = os.environ.get("OPINARA_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(sql.all_oracles()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.all_queries()[name](spark, FOLDER)
    cursor = connection.execute(sql.all_oracles()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(tuple, df.select(columns).collect())) == Counter(cursor.fetchall())
