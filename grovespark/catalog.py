"""Names of all queries of the graph engine."""

from __future__ import annotations

from grovespark.plans import queries as plans


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict:
    return dict(plans.ORACLES)
