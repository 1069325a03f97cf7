"""Registered queries of the ranking engine and the SQL they are held against."""

from __future__ import annotations

from rankweave.plans import q_features, q_ranking, q_state  # noqa: F401  they register
from rankweave.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
