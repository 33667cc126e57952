"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import EXTRA, entry, oracle_sql, queries
from check import canonical


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


# Queries without SQL are held against brute force where their operator is tested.
@pytest.mark.parametrize("name", sorted(n for n in queries() if n in oracle_sql() and n not in EXTRA))
def test_query_equals_sql(spark, con, sf, name):
    df = queries()[name](spark, sf)
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), names)


def test_entry(spark):
    assert entry(spark).columns[:3] == ["query_id", "question", "answer"]
