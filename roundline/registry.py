"""Registered queries of the library and their SQL."""

from __future__ import annotations


from .plans import evaluation, intervals, judging, learning, live, scalars, sequences, sources  # noqa: F401  (they register)
from .plans.base import PLANS, Query
from .plans.judging import flagship


def queries() -> dict[str, Query]:
    return {name: p.run for name, p in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: p.sql for name, p in PLANS.items() if p.sql}


__all__ = ["flagship", "oracle_sql", "queries"]
