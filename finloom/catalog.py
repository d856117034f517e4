"""All queries of the core, with their SQL."""

from __future__ import annotations

from finloom.queries import QUERIES, SQL
from finloom.queries import records as _records  # noqa: F401
from finloom.queries import retrieval
from finloom.queries import text as _text  # noqa: F401

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]

FLAGSHIP = retrieval.hybrid_topk
