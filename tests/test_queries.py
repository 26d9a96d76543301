"""Every registered query against its SQL twin, on whole tables."""

import compare
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return compare.duck(folder)


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 120


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    if name in ORACLE:
        assert compare.mismatch(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 15
