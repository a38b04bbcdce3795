import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__  # noqa: E402,F401  (also makes worker functions travel by value)
from recollect.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def col_values(spark):
    """Evaluate column expressions over rows given as dicts with a DDL schema."""

    def run(schema, rows, **columns):
        frame = spark.createDataFrame([tuple(r) for r in rows], schema)
        return [tuple(r) for r in frame.select(*[c.alias(n) for n, c in columns.items()]).collect()]

    return run
