"""Operator families; importing this package registers their queries."""

from __future__ import annotations


def all_queries() -> dict:
    _load()
    from .registry import QUERIES

    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    from .registry import SQL

    return dict(SQL)


def _load() -> None:
    from . import bulk, dml, relational, scalars, scans, sharding, streams  # noqa: F401
