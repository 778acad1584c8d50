import os

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, rows_of, rows_of_sql, tables

CORE = [m for m in entry._modules() if m.__name__ in entry.CORE]
QUERIES = {k: f for m in CORE for k, f in m.QUERIES.items()}
SQL = {k: s for m in CORE for k, s in m.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert rows_of(QUERIES[name](spark, DATA)) == rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_with_a_stable_schema(spark, name):
    first = QUERIES[name](spark, DATA)
    assert first.count() > 0 and first.schema == QUERIES[name](spark, DATA).schema


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_package_is_shipped_once(spark):
    from assayloom.shared import ship

    ship(spark)
    ship(spark)
    assert sum("assayloom.zip" in f for f in spark.sparkContext.listFiles) == 1
