"""Tables bucketed by their join key when they are written, so that joins on it need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from brindle.operators.stored import new_path


def bucketed(df: DataFrame, key: str, buckets: int, name: str = "bucketed") -> DataFrame:
    """df written to a table of so many buckets by hash of the key, each sorted by it, below the shared folder, and read again.

    Two such tables with one number of buckets join, group and deduplicate by the key without an exchange. The table stays
    in the session's catalog under its own name, for other queries to use.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    # Rows are dealt to the buckets first: one file each, not one for each task and bucket.
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", new_path(spark, table)).saveAsTable(table)
    return spark.table(table)
