"""Registered queries over the driver's tables, each with the SQL it is compared with.

tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


class Registry(dict):
    """name -> Registered, filled by decorators."""

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(run: Query) -> Query:
            if name in self:
                raise ValueError(f"query {name} is registered twice")
            self[name] = Registered(run, sql)
            return run

        return register


def all_queries() -> dict[str, Registered]:
    from . import files, pages, quality, relational, text, versions, views

    combined: dict[str, Registered] = {}
    for module in (pages, text, relational, views, versions, quality, files):
        for name, registered in module.REGISTRY.items():
            if name in combined:
                raise ValueError(f"query {name} is registered twice")
            combined[name] = registered
    return combined
