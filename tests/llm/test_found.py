"""Every found query against SQL over the same small tables."""

import pytest

import __spark_entry__ as entry
from oracle import DATA, connect, spark_rows, sql_rows
from reelquilt.llm import queries


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    assert spark_rows(queries.queries()[name](spark, f"{DATA}/sf0.001")) == sql_rows(con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    df = queries.queries()[name](spark, f"{DATA}/sf0.001")
    assert df.count() >= 0 and df.columns


def test_registered():
    assert set(queries.queries()) <= set(entry.queries())


COLUMNS = {
    "p2_found": {"video_idx_a": "int", "video_idx_b": "int"},
    "p3_found": {"video_idx": "int", "group_video_idx": "int"},
    "p4_found": {"video_id": "string", "statement_index": "int"},
    "p5_found": {"video_id": "string", "first_frame_idx": "int", "last_frame_idx": "int"},
    "p7_found": {"video_id": "string"},
    "p8_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p9_found": {"source": "string"},
    "p10_found": {"doc_id": "bigint", "lang": "string"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert dict(queries.queries()[name](spark, f"{DATA}/sf0.001").dtypes) == COLUMNS[name]
