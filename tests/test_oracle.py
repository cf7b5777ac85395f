"""Every registered query against its SQL in DuckDB, values and types."""

import pytest
from compare import duck, duck_result, duck_types, normalise

import __spark_entry__ as entry_module
from netvigil.plans import registered

SQL = entry_module.oracle_sql()
QUERIES = {name: f for name, f in entry_module.queries().items() if name in SQL}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(registered.QUERIES) <= set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_same_result(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert dict(df.dtypes) == duck_types(con, SQL[name])
    columns, rows = normalise(df.columns, df.collect())
    assert rows, "an empty result checks nothing"
    expected_columns, expected = duck_result(con, SQL[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["ip", "country", "attempts", "risk"]
    assert df.count() == 4
