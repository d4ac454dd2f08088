"""Registered queries over the given tables."""

from lekhya.plans import (flow_queries, index_queries, processing_queries,  # noqa: F401
                          record_queries, retrieval_queries, text_queries)
from lekhya.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
