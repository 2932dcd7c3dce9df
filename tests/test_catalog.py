"""Every registered query with SQL gives the SQL's rows."""

import glob
import math
import os

import duckdb
import pytest

import studyspark.catalog  # noqa: F401
from studyspark.catalog.base import REGISTRY

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        cells = []
        for i in order:
            v = r[i]
            if isinstance(v, float):
                v = None if math.isnan(v) else round(v, 6) + 0.0
            cells.append(v)
        out.append(tuple(cells))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck(data):
    return connected(data)


def connected(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", ["folds_of_wide_ids", "split_by_entity", "split_random", "split_stratified"])
def test_hashes_of_more_ids(spark, name):
    """Products of hashes of small ids stay small; a larger table shows an overflow."""
    folder = "/root/testdata/sf0.01"
    test_matches_sql(spark, folder, connected(folder), name)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_matches_sql(spark, data, duck, name):
    q = REGISTRY[name]
    df = q.run(spark, data)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(q.sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    kinds = {c[0]: str(c[1]) for c in cur.description}
    for f in df.schema:
        assert TYPES[f.dataType.simpleString()] == kinds[f.name], f.name
    assert _canon(got, df.columns) == _canon(cur.fetchall(), cols)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
