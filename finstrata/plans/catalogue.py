"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from finstrata.plans import documents, pages, review, rows, selection, text, units, validate

_MODULES = (text, rows, pages, documents, validate, review, selection, units)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
