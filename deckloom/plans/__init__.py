"""Registered queries and their checking SQL."""

from deckloom.plans.registry import CHECKS, QUERIES
from deckloom.plans import (  # noqa: F401
    catalog_queries, content_queries, eval_queries, layout_queries, package_queries, patch_queries, pixel_queries,
    reader_queries, scalars, sink_queries, stream_queries)

__all__ = ["CHECKS", "QUERIES"]
