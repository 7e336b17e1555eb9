"""The engine's queries and their oracle SQL, by name."""

from __future__ import annotations

from fieldspan.plans import analytics, answers, candidates, crawl, documents, evaluation, extraction, fallback, judging, keypaths, learning, resolve, tables, values
from fieldspan.plans.common import Query
from fieldspan.plans.documents import typed_pages

_REGISTERS = (documents.register, values.register, candidates.register, analytics.register, judging.register, tables.register, keypaths.register, fallback.register, evaluation.register, resolve.register, answers.register, learning.register, extraction.register, crawl.register)

QUERIES: dict[str, Query] = {k: q for r in _REGISTERS for k, q in r.queries.items()}
ORACLE_SQL: dict[str, str] = {k: s for r in _REGISTERS for k, s in r.sql.items()}

__all__ = ["ORACLE_SQL", "QUERIES", "typed_pages"]
