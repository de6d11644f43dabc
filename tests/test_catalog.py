"""Every query with SQL gives the SQL's rows on the smallest tables; the driver repeats this on larger ones."""

import os

import duckdb
import pytest

from wavelark import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in "region nation events customer part".split():
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name not in catalog.oracle_sql():
        assert len(got.columns)
        return
    want = sql.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (want, got))
    assert len(a) == len(b) and all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in columns)


def test_whole_counts(spark):
    run = lambda name: catalog.queries()[name](spark, SF)
    assert {r.subject for r in run("wilcoxon_w").collect()} == {0, 1, 2}
    p = [r.p_value * 1001 for r in run("peak_perm_test").collect()]
    assert p and all(abs(x - round(x)) < 1e-3 for x in p)
    assert run("onset_perm_summary").first().n_valid > 10_000
