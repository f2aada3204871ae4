"""Every registered query with SQL gives the rows of its SQL; the others give rows."""

import pytest
from sparrowmill import plans

from compare import SF, connect, rows_of_spark, rows_of_sql

LEAST_ROWS = {"semantic_chunk", "fuzzy_anchors"}


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_like_sql(spark, sql, name):
    assert rows_of_spark(plans.QUERIES[name](spark, SF)) == rows_of_sql(sql, plans.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert name in LEAST_ROWS
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_needs_the_corpus_operators():
    import pathlib

    root = pathlib.Path(plans.__file__).resolve().parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
