"""Every query with SQL gives DuckDB's rows on the small tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return str(x)
        return "nan" if isinstance(x, float) and math.isnan(x) else f"{round(float(x), 5):g}"

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert plain(df.select(*(f"`{c}`" for c in cols)).collect()) == plain(rel.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.catalogue.QUERIES) - set(entry.catalogue.ORACLES)))
def test_without_sql(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
