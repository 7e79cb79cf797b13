"""All registered queries of this package; importing it fills ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from . import (  # noqa: F401
    decontaminate_queries,
    dedup_queries,
    language_queries,
    media_queries,
    merkle_queries,
    mixing_queries,
    quality_queries,
    scan_queries,
    spelling_queries,
    token_queries,
    toxicity_queries,
)
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
