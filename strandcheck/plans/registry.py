"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a function of (session, folder) under ``name``."""

    def register(build: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = Query(name, build, sql)
        return build

    return register


def all_queries() -> dict[str, Query]:
    from . import alignment_queries, byte_queries, file_queries, index_queries, read_queries  # noqa: F401

    return dict(_QUERIES)
