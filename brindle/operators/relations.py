"""Relations between tables: quantifiers as semi and anti joins, nesting, counts and ordering by a relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.predicates import where
from brindle.operators.paging import orders, sort_column


def _keyed(child: DataFrame, fk: str, spec: dict | None, failing: bool = False) -> DataFrame:
    passes = where(spec)
    # A child whose condition is unknown doesn't pass.
    return child.filter(~F.coalesce(passes, F.lit(False)) if failing else passes).select(F.col(fk).alias("_fk"))


def some(parent: DataFrame, key: str, child: DataFrame, fk: str, spec: dict | None = None) -> DataFrame:
    """Parents with a child that passes."""
    return parent.join(_keyed(child, fk, spec), F.col(key) == F.col("_fk"), "left_semi")


def none(parent: DataFrame, key: str, child: DataFrame, fk: str, spec: dict | None = None) -> DataFrame:
    """Parents without a child that passes; those without children are among them."""
    return parent.join(_keyed(child, fk, spec), F.col(key) == F.col("_fk"), "left_anti")


def every(parent: DataFrame, key: str, child: DataFrame, fk: str, spec: dict | None = None) -> DataFrame:
    """Parents without a child that fails; those without children are among them."""
    return parent.join(_keyed(child, fk, spec, failing=True), F.col(key) == F.col("_fk"), "left_anti")


def is_(child: DataFrame, fk: str, parent: DataFrame, key: str, spec: dict | None = None) -> DataFrame:
    """Children whose parent passes."""
    return child.join(parent.filter(where(spec)).select(F.col(key).alias("_pk")), F.col(fk) == F.col("_pk"), "left_semi")


def is_not(child: DataFrame, fk: str, parent: DataFrame, key: str, spec: dict | None = None) -> DataFrame:
    """Children whose parent doesn't pass; those without a parent are among them."""
    return child.join(parent.filter(where(spec)).select(F.col(key).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def is_null(child: DataFrame, fk: str) -> DataFrame:
    return child.filter(F.col(fk).isNull())


def nest_one(child: DataFrame, fk: str, parent: DataFrame, key: str, name: str, columns: Sequence[str], required: bool = False) -> DataFrame:
    """The parent as a struct column; null where there is none (or no row, if it is required)."""
    p = parent.select(F.col(key).alias("_pk"), F.struct(*columns).alias(name))
    return child.join(p, F.col(fk) == F.col("_pk"), "inner" if required else "left").drop("_pk")


def nest_many(
    parent: DataFrame, key: str, child: DataFrame, fk: str, name: str, columns: Sequence[str], child_keys: Sequence[str],
    filter: dict | None = None, order_by: Sequence[str | tuple] = (), skip: int = 0, take: int | None = None, distinct: Sequence[str] | None = None,
) -> DataFrame:
    """The children as an array of structs in order, paged within each parent; empty where there are none."""
    order = [sort_column(o) for o in orders(order_by, child_keys)]
    rows = child.filter(where(filter))
    if distinct:
        rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy(fk, *distinct).orderBy(*order))).filter("_d = 1").drop("_d")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(fk).orderBy(*order)))
    rows = rows.filter((F.col("_n") > skip) & (F.lit(True) if take is None else F.col("_n") <= skip + take))
    item = F.struct("_n", *columns)
    nested = rows.groupBy(F.col(fk).alias("_fk")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    nested = nested.select("_fk", F.transform("_items", lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))
    out = parent.join(nested, F.col(key) == F.col("_fk"), "left").drop("_fk")
    return out.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def relation_count(parent: DataFrame, key: str, child: DataFrame, fk: str, name: str, spec: dict | None = None) -> DataFrame:
    n = _keyed(child, fk, spec).groupBy("_fk").agg(F.count("*").alias(name))
    return parent.join(n, F.col(key) == F.col("_fk"), "left").drop("_fk").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def traverse(rows: DataFrame, *steps: tuple[str, DataFrame, str]) -> DataFrame:
    """Follow to-one relations: each step is (foreign key, parent, its key); the rows of the last parent, one per start."""
    for fk, parent, key in steps:
        start = rows.select(F.col(fk).alias("_fk"))
        rows = start.join(parent, F.col("_fk") == F.col(key)).drop("_fk")
    return rows


def list_lookup(rows: DataFrame, ids: str, target: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """Rows of target whose key is in one of the id lists, once each however often it is listed."""
    wanted = rows.select(F.explode(ids).alias("_id"))
    t = target if keep is None else target.filter(keep)
    return t.join(wanted, F.col(key) == F.col("_id"), "left_semi")
