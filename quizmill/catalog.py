"""All queries of the library and their SQL."""

from __future__ import annotations

from quizmill.queries import answers, assets, booklets, coverage, details, documents, exams, listings, pages, reads, scores, shapes, writes  # noqa: F401
from quizmill.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
