"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from . import event_queries, kernel_queries, model_queries, moving_queries, preservation_queries, regime_queries, risk_queries, series_queries, space_queries  # noqa: F401
from .base import QUERIES, SQL

FLAGSHIP = "drought_events"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
