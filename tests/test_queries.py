import pytest

import __spark_entry__ as entry
from oracle import DATA, connect, spark_rows, sql_rows
from reelquilt import queries

CORE, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.001")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["video_id", "max_score", "best_statement"]
    assert df.count() > 0


def test_registry():
    assert set(CORE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert spark_rows(CORE[name](spark, f"{DATA}/sf0.001")) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_without_sql(spark, name):
    df = CORE[name](spark, f"{DATA}/sf0.001")
    assert df.count() > 0
