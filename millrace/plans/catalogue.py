"""All registered queries."""

from __future__ import annotations

from . import anomaly_queries, contract_queries, event_queries, execution_queries, flow_queries, ledger_queries, report_queries, stream_queries  # noqa: F401  they register themselves
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
