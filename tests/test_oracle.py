"""Every query with SQL gives the rows of DuckDB on the smallest tables."""

import decimal

import pytest

from lumenframe.plans.queries import QUERIES, SQL
from tests.conftest import DATA


def _key(row):
    return tuple(repr(float(x)) if isinstance(x, decimal.Decimal) else repr(x) for x in row)


def same(df, con, sql):
    columns = sorted(df.columns)
    rows = sorted(_key(r) for r in df.select(*columns).collect())
    assert sorted(con.sql(sql).columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(_key(r) for r in con.sql(f"select {quoted} from ({sql})").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    if name == "samples_in_order":  # the list holds an id of larger tables
        duck = duck.cursor()
    same(QUERIES[name](spark, DATA), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
