"""All queries of the library proper, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgloom.plans import file_queries, graph_queries, link_queries, order_queries, prediction_queries, step_queries, training_queries, vector_queries

_MODULES = (graph_queries, prediction_queries, vector_queries, file_queries, step_queries, training_queries, link_queries, order_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
