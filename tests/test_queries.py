"""Every registered query against its SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_points  # noqa: E402
import oracle  # noqa: E402
from conftest import SF_DIR  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="example tables not present")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry_points.oracle_sql()))
def test_query(spark, connection, name):
    got = oracle.spark_rows(entry_points.queries()[name](spark, SF_DIR))
    assert got == oracle.sql_rows(connection, entry_points.oracle_sql()[name])


def test_entry(spark):
    assert entry_points.entry(spark).count() == 9
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
