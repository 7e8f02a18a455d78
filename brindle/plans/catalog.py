"""All registered queries with the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import cluster_queries, extra_queries, filter_queries, ledger_queries, mining_queries, nested_queries, relation_queries, scale_queries, state_queries, stream_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (ledger_queries, filter_queries, relation_queries, stream_queries, extra_queries, nested_queries, mining_queries, cluster_queries, scale_queries, state_queries)


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, (_, s) in m.QUERIES.items() if s is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_queries.QUERIES["flagship_wallet"][0](spark, sf_dir)
