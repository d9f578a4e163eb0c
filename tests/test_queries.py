"""Every query of the library against its SQL, at the smallest scale."""

import duckdb
import pytest
from fluvial.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 9) if isinstance(x, float) else x.item() if hasattr(x, "item") else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf_dir, db, name):
    got = catalog.queries()[name](spark, sf_dir)
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"topology_methods"}))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
