"""All queries on the reconciliation tables."""

from __future__ import annotations

from ledgerloom.plans import chaining, grouping, importing, queries, registry, replaying, retrieving, reviewing, texting

QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL
overview = queries.audit_overview

__all__ = ["ORACLE_SQL", "QUERIES", "chaining", "grouping", "importing", "overview", "replaying", "retrieving", "reviewing", "texting"]
