import datetime as dt
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wanderlens.session import local_session  # noqa: E402
from wanderlens.sources.schemas import TABLES, VISITOR  # noqa: E402

#: Operators take text ids as well as whole numbers: most tests use numbers, the derived tables text.
SCHEMAS = {
    name: re.sub(r"(user_id|cell_id|caller|callee) string", r"\1 bigint", schema)
    for name, schema in {**TABLES, "visitor": VISITOR}.items()
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "tests", str(tmp_path_factory.mktemp("stored")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def table(spark):
    """Build one of the input tables from tuples."""

    def build(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name])

    return build


def at(text):
    """``01 07:00:00`` as a time of January 2024."""
    return dt.datetime.strptime(f"2024-01-{text}", "%Y-%m-%d %H:%M:%S")


def day(number, month=1):
    return dt.date(2024, month, number)


def stop(user, text, cell, hours=1.0, lng=110.0, lat=20.0):
    ts = at(text)
    return (ts.date(), user, ts, cell, float(hours), lng, lat)


def rows(df, *columns):
    """Rows of a result as a sorted list of tuples."""
    found = map(tuple, df.select(*columns).collect() if columns else df.collect())
    return sorted(found, key=lambda row: [(value is not None, value) for value in row])
