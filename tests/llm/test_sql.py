"""The SQL of this subpackage's queries says what the queries do, on whole small tables."""

from pathlib import Path

import duckdb
import pytest

from foliate.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_and_query_agree(spark, name):
    made = QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    cursor = connection.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(str([plain(row[names.index(c)]) for c in columns]) for row in cursor.fetchall())
    got = sorted(str([plain(row[c]) for c in columns]) for row in made.collect())
    assert got == want and got
