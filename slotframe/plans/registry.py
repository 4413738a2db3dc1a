"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from slotframe.plans import graph_queries, key_queries, log_queries, scalar_queries
from slotframe.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "graph_queries", "key_queries", "log_queries", "scalar_queries"]
