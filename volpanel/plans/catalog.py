"""All registered queries, gathered from the query modules."""

from volpanel.plans import (  # noqa: F401
    queries_backtest,
    queries_chain,
    queries_compare,
    queries_daily,
    queries_forecast,
    queries_quotes,
    queries_score,
    queries_storage,
    queries_surface,
)
from volpanel.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
