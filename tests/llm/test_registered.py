"""Every registered query of the subpackage runs; those with SQL equal it."""

import duckdb
import pytest

from catalog.check import TABLES, compare
from cuelake.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    status, rows, _, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), FOLDER)
    assert status in ("OK", "ROWS") and rows > 0, note
