"""All registered queries and their comparison SQL."""

from . import quality_queries, rule_queries, signal_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "quality_queries", "rule_queries", "signal_queries"]
