"""Every registered query that has SQL must give the same rows as DuckDB."""

import os
import sys

import duckdb
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_point  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def kinds_of(table):
    """Column names with their Arrow types; only how long strings may be differs between the engines."""
    kinds = {f.name: pa.string() if pa.types.is_large_string(f.type) else f.type for f in table.schema}
    return sorted((n, str(t)) for n, t in kinds.items())


def rows_of(table):
    names = sorted(table.column_names)
    rows = zip(*[table[n].to_pylist() for n in names], strict=True)
    return names, sorted((tuple(None if v != v else v for v in r) for r in rows), key=repr)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in SQL:
        assert got.num_rows > 0
        return
    expected = duck.sql(SQL[name]).to_arrow_table()
    assert kinds_of(got) == kinds_of(expected)
    assert rows_of(got) == rows_of(expected)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 100
