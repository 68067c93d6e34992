import duckdb
import pytest

import __spark_entry__ as entry
from quillstone import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= len(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([r[c] for c in names]) for r in df.collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    made = duck.sql(catalog.oracle_sql()[name])
    assert sorted(made.columns) == names
    assert got == sorted(repr([r[made.columns.index(c)] for c in names]) for r in made.fetchall())
