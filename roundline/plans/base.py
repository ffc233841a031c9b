"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import with_views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Plan:
    run: Query
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is its DuckDB form after the adapters in ``views``."""

    def add(f: Query) -> Query:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = Plan(f, with_views(views, sql) if sql else None)
        return f

    return add
