"""Every query of the library by name, and its SQL where SQL can express it."""

from __future__ import annotations

from sheaf.plans import attempt_queries, document_queries, outline_queries, page_queries, reading_queries, text_queries, verdict_queries

QUERIES: dict = {}
ORACLES: dict = {}
for module in (outline_queries, text_queries, attempt_queries, verdict_queries, page_queries, document_queries, reading_queries):
    QUERIES |= module.queries.plans
    ORACLES |= module.queries.sql
