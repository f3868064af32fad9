"""Registered queries over the operators, with the SQL that must give the same rows."""

from __future__ import annotations

from quillmark.plans import catalogs, chunks, code, commits, loops, more, protocol, reads, recall, spaces, state, tabular, timed  # noqa: F401
from quillmark.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
