"""Registered queries: each Spark plan stands next to the SQL that must give the same rows."""

from gridloom.plans import altered_queries, flow_queries, scale_queries, text_queries, vector_queries
from gridloom.plans.registry import REGISTRY

__all__ = ["REGISTRY", "altered_queries", "flow_queries", "scale_queries", "text_queries", "vector_queries"]
