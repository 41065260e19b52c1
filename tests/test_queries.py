"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from catalog import all_queries
from catalog.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = all_queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    status, rows, _, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), FOLDER)
    assert status in ("OK", "ROWS"), note
