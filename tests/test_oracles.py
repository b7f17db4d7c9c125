"""Spark queries against their DuckDB SQL on the smallest tables; KBSPARK_ALL=1 runs every query that has SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kbspark.plans.base import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
SOME = [
    "A5", "A6", "A10", "A11", "B3", "B4", "B7", "B8", "C2", "C6", "C7_merge", "D1", "D2_l2", "D3", "E3", "E7", "E18", "E24", "F1", "F4", "F6", "F8_supplement", "F9", "G5", "G7", "G10_control",
    "H2", "H4", "I2", "I9", "I13", "I18", "I21", "J2", "J3", "J4",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float)):
        return None if v != v else float(v)
    return str(v)


def same(rows, columns, relation):
    theirs = relation.columns
    assert sorted(columns) == sorted(theirs)
    order = [theirs.index(c) for c in columns]
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(plain(r[i]) for i in order) for r in relation.fetchall()), key=key)
    assert sorted((tuple(map(plain, r)) for r in rows), key=key) == want


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("KBSPARK_ALL") else SOME)
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    same([tuple(r) for r in df.collect()], df.columns, duck.sql(ORACLES[name]))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
