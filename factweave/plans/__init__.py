"""Runnable queries over the given tables."""

from . import catalog_queries, conflict_queries, graph_queries, ingest_queries, log_queries, number_queries, quality_queries, search_queries, stream_queries, text_queries, tool_queries, whole_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
