"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from foretrace.plans import oracles, queries


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 7) if isinstance(value, float) else value


def test_every_query_has_sql():
    assert set(queries.REGISTRY) == set(oracles.ORACLES)
    assert set(queries.REGISTRY) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_same_rows(spark, sf_dir, name):
    got = queries.REGISTRY[name](spark, sf_dir)
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    columns = sorted(got.columns)
    found = db.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    key = lambda row: tuple((x is None, str(x)) for x in row)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    assert rows == sorted((tuple(plain(x) for x in r) for r in found), key=key)
