"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from derivia import engine_queries  # noqa: F401
from derivia.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(rows, places):
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in places) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, tables, name):
    frame = QUERIES[name](spark, SMALL)
    answer = tables.execute(ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _plain(frame.collect(), [frame.columns.index(c) for c in columns]) == _plain(answer.fetchall(), range(len(columns)))
