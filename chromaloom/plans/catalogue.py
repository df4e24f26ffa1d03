"""All queries of the library's own operators, with their SQL."""

from . import color_queries, geometry_queries, palette_queries, catalog_queries, learning_queries, region_queries, storage_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
