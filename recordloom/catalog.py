"""All registered queries of the record operators and their SQL."""

from __future__ import annotations

from recordloom.plans import rule_queries  # noqa: F401  registers its queries
from recordloom.plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
