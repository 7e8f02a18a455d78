"""Approximate aggregates kept as sketches: one row per key and period, merged into whatever is asked for later.

Distinct counts by HyperLogLog (relative standard error about 1.04 / 2 ** (lg / 2), 0.0163 at 12), quantiles by KLL (rank
error about 1.65 / k ** 0.95), overlaps of sets by theta sketches (about 1 / 2 ** (lg / 2) of the union). Small sets are
kept whole, so their answers are exact. Nulls are not counted; a key without values has a null estimate for quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG, K = 12, 4_096


def kept(rows: DataFrame, keys: list[str], distinct: str, value: str) -> DataFrame:
    """keys, distinct_hll, distinct_theta, value_kll and n of every key: what a period writes once."""
    return rows.groupBy(*keys).agg(
        F.hll_sketch_agg(distinct, LG).alias("distinct_hll"), F.theta_sketch_agg(distinct, LG).alias("distinct_theta"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("value_kll"), F.count(value).alias("n")
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of fewer keys, or of all rows: still sketches."""
    return sketches.groupBy(*keys).agg(
        F.hll_union_agg("distinct_hll").alias("distinct_hll"), F.theta_union_agg("distinct_theta", LG).alias("distinct_theta"), F.kll_merge_agg_double("value_kll", K).alias("value_kll"), F.sum("n").alias("n")
    )


def distinct_estimate() -> Column:
    return F.hll_sketch_estimate("distinct_hll")


def quantile(q: float) -> Column:
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("value_kll", F.lit(q)))


def common_estimate(a: str, b: str) -> Column:
    """How many values two theta sketches have in common."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))
