"""Queries of the operators over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from fieldnote.llm import queries_mined, queries_pages, queries_rows, queries_search, queries_text, queries_tokens  # noqa: F401  importing a module registers its queries
from fieldnote.llm.registry import JOBS, SQL

__all__ = ["JOBS", "SQL"]
