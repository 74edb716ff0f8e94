"""All queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memlake import plans
from memlake.plans import actions, entities, extraction, graph, hygiene, ingest, keys, layers, lifecycle, memory, retrieval, selectors, streams, texts, upkeep  # noqa: F401  they register their queries

FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
