"""Every query of the library itself beside its SQL, run by DuckDB over the same small tables."""

import math
import os

import duckdb
import pytest

from palimpsest.plans import more_queries, queries, script_queries, table_queries  # noqa: F401
from palimpsest.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in os.listdir(SF):
        at = f"{SF}/{t}" if os.path.isfile(f"{SF}/{t}") else f"{SF}/{t}/*.parquet"
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        assert len(rows) > 0
        return
    want = sql.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(str([plain(r[c]) for c in columns]) for r in rows) == sorted(str([plain(r[i]) for i in order]) for r in want.fetchall())
