"""Every query with SQL equals DuckDB on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from quillspark.plans import catalog, catalog_extra, catalog_files, catalog_more, catalog_reports  # noqa: F401 - all add to the catalog

D = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{D}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    cur = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_stream_equals_batch(spark):
    a = catalog.QUERIES["t_stream_change_feed"](spark, D).collect()
    b = catalog.QUERIES["w_change_feed"](spark, D).collect()
    key = lambda rows: sorted((r.task_id, r.seq) for r in rows if r.status in ("completed", "failed", "blocked"))
    assert key(a) == key(b)
