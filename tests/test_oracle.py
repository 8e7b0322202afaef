"""Every registered query against its DuckDB statement on the whole tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle.compare import connect, differences

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
STATEMENTS = entry.oracle_sql()
CORPUS = ("op", "pipeline")  # training-data queries have tests of their own


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_a_statement():
    own = {name for name in entry.queries() if not name.startswith(CORPUS)}
    assert own - set(STATEMENTS) == {"community_detection"}
    assert set(STATEMENTS) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in STATEMENTS if not n.startswith(CORPUS)))
def test_same_rows_as_duckdb(spark, duck, name):
    count, different = differences(entry.queries()[name](spark, FOLDER), duck, STATEMENTS[name])
    assert not different
    assert count > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
