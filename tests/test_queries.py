"""Every registered query against its SQL twin on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from dialoom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, str(plain(x))) for k, x in v.items()))
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def test_names_match():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_data_is_there():
    assert glob.glob(f"{SF}/*.parquet")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    assert len(set(frame.columns)) == len(frame.columns)
    if sql := registry.oracle_sql().get(name):
        found = duck.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(frame.columns)
        assert rows_of(frame.columns, rows) == rows_of(columns, found.fetchall())
