"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lexloom.plans import catalogue

SF = os.environ.get("LEXLOOM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name in catalogue.oracles():
        rel = duck.sql(catalogue.oracles()[name])
        at = [rel.columns.index(c) for c in sorted(rel.columns)]
        assert sorted(rel.columns) == sorted(df.columns)
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
