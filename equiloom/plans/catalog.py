"""All registered queries; importing this module fills the registry."""

from equiloom.plans import (  # noqa: F401
    oracle_views, queries_scores, queries_market, queries_evaluation, queries_series, queries_portfolio,
    queries_tables, queries_learning,
)
from equiloom.plans.registry import QUERIES, oracle, run

__all__ = ["QUERIES", "oracle", "run"]
