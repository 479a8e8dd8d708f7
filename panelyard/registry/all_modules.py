"""Importing this module registers every query."""
from . import detect_queries, feature_queries, graph_queries, harness_queries, join_queries, market_queries, panel_queries, read_queries, study_queries  # noqa: F401
