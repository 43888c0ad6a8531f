"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from frameloom.plans import catalogue


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return int(v) if isinstance(v, float) and v == int(v) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    found = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = [tuple(map(plain, r)) for r in found.select(*columns).collect()]
    assert rows
    if name in catalogue.oracle_sql():
        asked = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(asked.columns) == columns
        want = [tuple(map(plain, r)) for r in asked.select(", ".join(f'"{c}"' for c in columns)).fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == set()
