"""Every registered query of the metadata library equals its DuckDB form on the smallest tables."""

import glob
import os

import pytest

from pipelake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(rows):
    def cell(v):
        if v is None or v != v:
            return "-"
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = norm(df.select(*[f"`{c}`" for c in columns]).collect())
    assert got
    if name in ORACLES:
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert got == norm(duck.execute(f"SELECT {quoted} FROM ({ORACLES[name]}) q").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
