"""Every registered query against its SQL on the small tables."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry_points  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        note = compare(df, con, sql)
        assert note is None, note


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["doc_id", "block", "header", "text"]
