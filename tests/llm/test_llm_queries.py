"""Every query runs; those with an SQL twin equal it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.llm import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_runs(spark, name):
    rows = catalogue.queries()[name](spark, SF).collect()
    assert name in entry.queries()
    if name in catalogue.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW \"{f.removesuffix('.parquet')}\" AS SELECT * FROM '{SF}/{f}'")
        cur = con.execute(catalogue.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        assert sorted(tuple(map(repr, r)) for r in cur.fetchall()) == sorted(tuple(repr(r[c]) for c in cols) for r in rows)
