"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import ann, language, licenses, mixing, neardup, packing, periodic, pii, quality, repair, secrets, substring, urls

MODULES = (mixing, ann, quality, pii, neardup, secrets, substring, language, urls, packing, periodic, licenses, repair)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
