"""The registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from . import quality_queries, rule_queries, store_queries, view_queries
from .rule_queries import rule_header_total  # noqa: F401 - the driver's entry

MODULES = (rule_queries, view_queries, quality_queries, store_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
