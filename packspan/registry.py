"""Queries over the driver's tables, one or more for each operator, and their SQL twins."""

from __future__ import annotations

from packspan.plans import formats, queries as relational


def queries() -> dict:
    return relational.QUERIES | formats.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.ORACLES | formats.ORACLES
