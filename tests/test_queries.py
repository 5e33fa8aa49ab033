"""Every registered query of the collective engine against its SQL, on the small tables."""

import os

import pytest

from meshframe.plans import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, tables, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    rows = found.collect()
    cursor = tables.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted(tuple(map(str, (r[names.index(c)] for c in found.columns))) for r in cursor.fetchall())
    assert sorted(tuple(map(str, r)) for r in rows) == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
