"""Intermediate tables below the shared folder, so that loops don't grow their plans and lost executors lose nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brindle.session import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again."""
    at = new_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
