"""Every registered query that has SQL gives the rows of that SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lumiquarry.plans import registry

SF = os.environ.get("LUMIQUARRY_TESTDATA", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return float(v) if v.__class__.__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, tables, name):
    df = registry.queries()[name](spark, SF)
    result = tables.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(([plain(v) for v in r] for r in result.fetchall()), key=repr)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
