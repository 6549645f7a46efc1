"""Every registered query of the engine against its SQL in DuckDB."""

import glob
import os

import pytest

from foliate.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    made = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame, made = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(frame.columns)
    assert sorted(made.columns) == columns
    got = sorted(repr(tuple(map(plain, r))) for r in frame.select(*columns).collect())
    at = [made.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[k]) for k in at)) for r in made.fetchall())
    assert got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "markdown"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
