"""Registered queries and the SQL that checks them."""

from wickwork.plans import nights, results, scans
from wickwork.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "nights", "results", "scans"]
