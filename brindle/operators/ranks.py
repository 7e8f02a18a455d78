"""Values at exact ranks of groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.stored import stored
from brindle.operators.windows import carried_before


def values_at(rows: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], Column], times: str | None = None) -> DataFrame:
    """keys, n, found: how many values a group has, nulls left out, and those at ``ranks`` (an array, from 1) of that number.

    Equal values are one row with their number (``times``: a row counts so often), and numbers are carried along the order
    in ranges, so a group of any size is many tasks and no task holds a group's values.
    """
    each = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg((F.sum(times) if times else F.count("*")).alias("_times"))
    each = stored(each, "values")
    of = each.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(F.sum("_times").alias("n"))
    before = carried_before(each, keys, ["_v"], None, F.col("_times"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    hit = F.filter(ranks(F.col("n")), lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_times")))
    found = before.join(of, same).select(*keys, "n", "_v", F.explode(hit).alias("_rank"))
    return found.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_v"))), lambda x: x["_v"]).alias("found"))
