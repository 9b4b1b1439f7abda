"""Registry of named queries: (spark, sf_dir) -> DataFrame, plus oracle SQL."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    ids: tuple
    oracle: str | None


_QUERIES: dict[str, Query] = {}


def register(name: str, ids: str = "", oracle: str | None = None):
    """Decorator: register a query under `name` with the inventory ids it covers."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = Query(name, fn, tuple(ids.split()), oracle)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def _load() -> None:
    # importing the plan modules fills the registry
    from laborlens.plans import (survey, ageism, registry_plans, feed, files,  # noqa: F401
                                 quality, sampling_plans, models, streams, extras, summaries)
