"""Every query of the engine against its SQL, on the smallest input."""

import glob
import os

import duckdb
import pytest

from storyflow.plans import desk_queries, page_queries, publish_queries, record_queries, registry, report_queries, rule_queries, social_queries, store_queries, story_queries, stream_queries, text_queries  # noqa: F401


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = got.select(*[f"`{c}`" for c in cols]).toArrow()
    mine = sorted(map(repr, zip(*[c.to_pylist() for c in rows.columns])))
    if name not in registry.SQL:
        assert mine
        return
    want = con.sql(registry.SQL[name])
    assert sorted(want.columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    assert mine == sorted(map(repr, con.sql(f"SELECT {names} FROM ({registry.SQL[name]})").fetchall()))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
