"""The registered queries of the library and their SQL."""

from __future__ import annotations

from . import edits, guide, jobs, live, records, reports, scalars, written

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (edits, guide, scalars, reports, records, jobs, live, written):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
