"""The registered queries over the driver's tables, each with the SQL that must give the same rows."""

from . import (  # noqa: F401
    catalog_queries,
    file_queries,
    ingest_queries,
    match_queries,
    price_click_queries,
    source_queries,
    stream_queries,
    text_queries,
)
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
