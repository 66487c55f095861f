"""Every registered query against its oracle SQL at the smallest scale."""

import duckdb
import pytest

from tools.check_oracle import TABLES, compare
from volpanel.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
# Too few dates at this scale: the panels cannot be split. Checked at sf0.01 by tools/check_oracle.py.
NEEDS_MORE_DATES = {"backtest_losses", "backtest_confidence_set"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - NEEDS_MORE_DATES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF_DIR)
    assert len(set(frame.columns)) == len(frame.columns)
    if name in catalog.ORACLES:
        problem, _ = compare(frame, duck, catalog.ORACLES[name])
        assert not problem
    else:
        assert frame.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_are_plain():
    assert not [n for n in catalog.QUERIES if "pipeline" in n or n.startswith("op")]
