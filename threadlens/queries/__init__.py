"""Registered queries over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from threadlens.queries import blocks, dataset, decisions, engineering, nested, scenarios, vectors  # noqa: F401  these register their queries
from threadlens.queries.tables import QUERIES, SQL, flagship


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["flagship", "oracle_sql", "queries"]
