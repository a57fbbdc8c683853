"""Every query of the library against its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from vectrail.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"create view {file.split('.')[0]} as select * from '{data}/{file}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def same_rows(columns, rows, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, oracle, name):
    found = QUERIES[name](spark, data)
    wanted = oracle.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert same_rows(found.columns, [tuple(r) for r in found.collect()], sorted(columns)) == same_rows(columns, wanted.fetchall(), sorted(columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_works_without_the_optional_part(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() == 10
