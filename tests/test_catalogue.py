"""Every core query with an SQL twin equals it on the smallest tables."""

import os

import duckdb
import pytest

from lodestone import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW \"{f.removesuffix('.parquet')}\" AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_twin(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    cur = db.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(cols)
    order = sorted(cols)
    want = sorted(tuple(repr(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    assert sorted(tuple(repr(r[c]) for c in order) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= 0


def test_flagship(spark):
    assert {r["level"] for r in catalogue.flagship(spark, SF).collect()} == {"overall", "coarse", "fine"}
