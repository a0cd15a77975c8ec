"""Reports and restore plans composed from the operators, and the query registry."""

from cycle_analytics.plans import content_queries, integrity_queries, pass_queries, report_queries, source_queries, table_queries, time_queries
from cycle_analytics.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "content_queries", "integrity_queries", "pass_queries", "report_queries", "source_queries", "table_queries", "time_queries"]
