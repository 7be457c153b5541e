"""Named queries: each is ``(spark, sf_dir) -> DataFrame`` over the given tables, with
an equivalent DuckDB SQL text where one exists (the correctness oracle).

Results are flat (one row per page, per array element, or per group) with every
computed column aliased, so both engines produce the same column names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, oracle: str | None = None, headline: bool = False):
    """Decorator adding a query (and its oracle SQL) to the catalogue."""
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        if headline:
            HEADLINE.append(name)
        return fn
    return wrap


QUERY_MODULES = ("q_pages", "q_text", "q_quality", "q_service", "q_federate", "q_links",
                 "q_search", "q_serp", "q_providers", "q_stateful", "q_records")


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for mod in QUERY_MODULES:
        importlib.import_module(f"{__package__}.{mod}")
