"""Registry of the core queries and their SQL."""

from __future__ import annotations

from . import alignments, annotation, counting, formats, problems, utilities

_MODULES = (counting, alignments, annotation, utilities, formats, problems)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.oracle_sql().items()}
