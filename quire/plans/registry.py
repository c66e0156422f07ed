"""All queries of the library by name, and the SQL they are held against."""

from __future__ import annotations

from quire.plans import book_plans, document_plans, relation_plans, text_plans

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (text_plans, relation_plans, document_plans, book_plans):
    QUERIES |= _part.Q
    ORACLES |= _part.O
