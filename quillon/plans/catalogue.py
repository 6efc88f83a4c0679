"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from quillon.plans import audits, competition, exams, inspecting, phrasing, relational, rules, small, structure, texts

_PACKS = (relational, competition, texts, inspecting, small, rules, structure, audits, exams, phrasing)
QUERIES: dict = {k: v for p in _PACKS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict = {k: v for p in _PACKS for k, v in p.ORACLE_SQL.items()}
