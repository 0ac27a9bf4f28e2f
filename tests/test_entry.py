"""Every registered query that has SQL gives DuckDB's rows."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from quarry.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(table):
    names = sorted(table.column_names)
    return names, Counter(zip(*(map(str, table.column(n).to_pylist()) for n in names), strict=True))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("nation", "part", "orders", "lineitem", "documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toArrow()) == rows(duck.sql(ORACLE_SQL[name]).to_arrow_table())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
