"""Every registered query against its SQL twin on the small tables, where they are at hand."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from factgraph.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    return plain(float(value)) if type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        base.sql(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    return base


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 100


def test_flagship(spark):
    assert catalog.entry(spark, FOLDER).columns == ["entity", "rel_type", "target", "strength", "rank"]
