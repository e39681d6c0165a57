"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from . import filters, gating, joins, landing, pairing, publishing, scalars, stats, voting  # noqa: F401  each registers its queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
