"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import os

import pytest

from logweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "events", "pages", "orders", "customer")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name not in catalog.oracle_sql():
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)
