"""Registry of build keys: a Spark query and, where SQL can say it, the
equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate build key {key!r}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every binding module so that it registers its keys."""
    from ledgerfold.plans import (  # noqa: F401
        bind_checked,
        bind_cleaning,
        bind_eval,
        bind_features,
        bind_joins,
        bind_models,
        bind_profile,
        bind_sources,
        bind_streaming,
    )
