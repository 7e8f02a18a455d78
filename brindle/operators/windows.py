"""Values carried along an order without a task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.stored import stored


def carried_before(rows: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column | None, value: Column, name: str, last: bool = False, piece_rows: int = 1_000_000) -> DataFrame:
    """rows with ``name``: the sum of value, or its last that isn't null, over the earlier rows of a key in an order.

    The order is cut into pieces, each windowed apart, and each gets what the pieces before it carry: a row a piece. So a
    key that a third of all rows share is many tasks. Without ``bucket`` the pieces are ranges of key and order of about
    ``piece_rows`` rows, however many come in a time; a bucket (an hour, say) gives pieces that grow with the rows of an hour.
    """
    if bucket is None:
        pieces = max(1, -(-rows.count() // piece_rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        cut = rows.repartitionByRange(pieces, *[F.col(c) for c in (*key, *order)]).withColumn("_piece", F.spark_partition_id())
        rows, bucket = stored(cut, "pieces"), F.col("_piece")
    rows = rows.withColumn("_piece", bucket).withColumn("_value", value)
    whole = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))) if last else F.sum("_value")
    of = lambda frame: F.last("_value", ignorenulls=True).over(frame) if last else F.sum("_value").over(frame)
    pieces = rows.groupBy(*key, "_piece").agg(whole.alias("_value"))
    so_far = of(Window.partitionBy(*key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*key, "_piece"])], so_far.alias("_carry"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*key, "_piece"])]
    inside = of(Window.partitionBy(*key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("_inside", inside).join(pieces, same)
    both = F.coalesce("_inside", "_carry") if last else F.coalesce("_inside", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return out.withColumn(name, both).select(*[c for c in rows.columns if c not in ("_piece", "_value")], name)
