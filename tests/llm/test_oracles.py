"""Training-data queries next to their oracle SQL at the smallest scale."""

import duckdb
import pytest

from tools.check_oracle import TABLES, compare
from volpanel.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    problem, rows = compare(queries.QUERIES[name](spark, SF_DIR), duck, queries.ORACLES[name])
    assert not problem
    assert rows > 0


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
