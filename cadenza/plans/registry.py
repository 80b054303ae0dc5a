"""The library's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cadenza.plans import catalogs, decisions, features, files, operations, serving, streams
from cadenza.sources.shared import deal_as_before

GROUPS = (features, serving, operations, files, streams, catalogs, decisions)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by session co-occurrence over the training transitions."""
    return serving.recall_cooc(spark, sf_dir)


def _dealt(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """`query` with the number of shuffle partitions that its own tables ask for, not those of the query before."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        deal_as_before(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _dealt(query) for group in GROUPS for name, (query, _) in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for group in GROUPS for name, (_, text) in group.QUERIES.items() if text}
