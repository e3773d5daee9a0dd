"""Every query that has SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import pytest

from voxelflow.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = ("lineitem", "embeddings", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, got) == _rows(columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["gradient_magnitude", "vesselness"])
def test_last_slice_is_not_full(name, spark, tmp_path):
    """Vectors whose number is no multiple of a slice's, with one missing within."""
    con = duckdb.connect()
    con.execute(f"copy (select * from '{DATA}/embeddings.parquet' where vec_id < 136 and vec_id <> 47) to '{tmp_path}/embeddings.parquet'")
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.execute(SQL[name])
    assert _rows(df.columns, df.collect()) == _rows([d[0] for d in want.description], want.fetchall())
