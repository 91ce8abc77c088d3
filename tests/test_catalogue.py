"""Every query of the catalogue against its SQL on the smallest tables."""

import math
import os

import pytest

from sessionloom import catalogue

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(map(_plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, other, name):
    found = catalogue.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    spark.catalog.clearCache()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    expected = other.sql(catalogue.oracle_sql()[name])
    names = expected.columns
    assert columns == sorted(names)
    assert rows == sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in expected.fetchall()), key=repr)
