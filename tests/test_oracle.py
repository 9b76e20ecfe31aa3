"""Every query with SQL against DuckDB over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, found):
    """Rows with their columns in order of name; numbers of any kind compare by value."""
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = [[float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in (row[i] for i in order)] for row in found]
    return sorted(plain, key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = con.sql(entry.oracle_sql()[name])
    made = entry.queries()[name](spark, SF)
    assert sorted(made.columns) == sorted(expected.columns)
    assert rows(made.columns, made.collect()) == rows(expected.columns, expected.fetchall())


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
