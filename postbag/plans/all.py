"""Imports every module of queries, so that the registry is full."""

from . import graph_queries, hypergraph_queries, ingest_queries, report_queries, time_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
