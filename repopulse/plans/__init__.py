"""Registered queries: name to function of (spark, folder), and the oracle SQL of each."""

from . import discovery_queries, event_queries, repo_queries, scan_queries, stream_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "discovery_queries", "event_queries", "repo_queries", "scan_queries", "stream_queries"]
