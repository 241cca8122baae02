"""All named queries over the given tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

from gleanspark.queries import indexing, pages, retrieval, scoring, words  # noqa: F401  (they register theirs)
from gleanspark.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
