"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from deckloom.session import local_session

    return local_session(8)


@pytest.fixture
def table(spark):
    """Small tables from rows and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df, *cols):
    """Sorted tuples of the given columns, nulls last."""
    return sorted((tuple(r) for r in df.select(*cols).collect()),
                  key=lambda t: [(v is None, 0 if v is None else v) for v in t])
