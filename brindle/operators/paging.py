"""Reading operators: projection, order, cursor, distinct, offset paging and single rows.

The order of work is: where, order, cursor, distinct, skip, take, select. Orders are total: the key columns are always
the last sort keys, so pages never overlap. Ascending order has nulls last and descending order nulls first unless said
otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.predicates import unique_where, where


class NotFound(LookupError):
    """No row where one must be."""


#: (column, "asc" or "desc", "first", "last" or None for the default place of nulls)
Order = tuple[str, str, str | None]


def orders(spec: Sequence[str | tuple], keys: Sequence[str]) -> list[Order]:
    out = [(s, "asc", None) if isinstance(s, str) else (*s, None)[:3] for s in spec]
    return out + [(k, "asc", None) for k in keys if k not in {o[0] for o in out}]


def sort_column(o: Order, reverse: bool = False) -> Column:
    name, way, nulls = o
    nulls = nulls or ("last" if way == "asc" else "first")
    if reverse:
        way, nulls = {"asc": "desc", "desc": "asc"}[way], {"first": "last", "last": "first"}[nulls]
    return getattr(F.col(name), f"{way}_nulls_{nulls}")()


def project(df: DataFrame, select: Sequence[str] | None = None, omit: Sequence[str] | None = None) -> DataFrame:
    if select is not None and omit is not None:
        raise ValueError("select and omit exclude each other")
    return df.select(*select) if select is not None else df.drop(*omit) if omit is not None else df


def kept_fields(fields: Sequence[str], select: Column, omit: Column) -> tuple[Column, Column]:
    """The rules of project() for requests that are rows: what is wrong with the request, if anything, and the fields kept.

    select and omit are arrays of names, null where a request has none; names that aren't fields are an error.
    """
    every = F.array(*[F.lit(f) for f in fields])
    named = F.coalesce(select, omit, F.array().cast("array<string>"))
    problem = F.when(select.isNotNull() & omit.isNotNull(), "select and omit").when(F.size(F.array_except(named, every)) > 0, "unknown field")
    kept = F.when(select.isNotNull(), F.array_intersect(every, select)).when(omit.isNotNull(), F.array_except(every, omit)).otherwise(every)
    return problem, F.when(problem.isNull(), kept)


def _at_or_after(order: list[Order]) -> Column:
    """Rows not before the cursor row, whose sort values are in columns _cursor_<name>: a comparison of tuples."""
    alternatives, equal = [], F.lit(True)
    for name, way, nulls in order:
        mine, its = F.col(name), F.col(f"_cursor_{name}")
        nulls = nulls or ("last" if way == "asc" else "first")
        beyond = F.coalesce(mine > its if way == "asc" else mine < its, F.lit(False))
        to_null = (mine.isNull() & its.isNotNull()) if nulls == "last" else (mine.isNotNull() & its.isNull())
        alternatives.append(equal & (beyond | to_null))
        equal = equal & mine.eqNullSafe(its)
    return reduce(or_, alternatives, equal)


def find_many(
    df: DataFrame,
    keys: Sequence[str],
    filter: dict | None = None,
    order_by: Sequence[str | tuple] = (),
    cursor: dict | None = None,
    distinct: Sequence[str] | None = None,
    skip: int = 0,
    take: int | None = None,
    select: Sequence[str] | None = None,
    omit: Sequence[str] | None = None,
) -> DataFrame:
    """cursor: the key of the row to begin with (no such row, no rows). A negative take gives the last rows in order;
    skip then counts from the end, and a cursor is the last row."""
    order = orders(order_by, keys)
    back = take is not None and take < 0
    out = df.filter(where(filter))
    if cursor is not None:
        way = [(n, {"asc": "desc", "desc": "asc"}[w], {"first": "last", "last": "first"}[x or ("last" if w == "asc" else "first")]) for n, w, x in order] if back else order
        row = df.filter(where(cursor)).limit(1).select(*[F.col(o[0]).alias(f"_cursor_{o[0]}") for o in order])
        out = out.join(F.broadcast(row), _at_or_after(way)).select(*df.columns)  # one row
    if distinct:
        first = Window.partitionBy(*distinct).orderBy(*[sort_column(o, back) for o in order])
        out = out.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    out = out.orderBy(*[sort_column(o, back) for o in order])
    if skip:
        out = out.offset(skip)
    if take is not None:
        out = out.limit(abs(take))
    if back:
        out = out.orderBy(*[sort_column(o) for o in order])
    return project(out, select, omit)


def find_unique(df: DataFrame, keys: list[tuple[str, ...]], filter: dict, **columns) -> DataFrame:
    return project(df.filter(unique_where(filter, keys)), **columns)


def find_first(df: DataFrame, keys: Sequence[str], **query) -> DataFrame:
    return find_many(df, keys, **query | {"take": -1 if (query.get("take") or 1) < 0 else 1})


def or_throw(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise NotFound("no row")
    return df


def latest_of(df: DataFrame, owner: str, at: str, row: str = "job") -> DataFrame:
    """The newest row of each owner, missing times as 0; filtered before it is limited."""
    newest = F.struct(F.coalesce(F.col(at), F.lit(0)).alias("at"), *[F.col(c) for c in df.columns if c not in (owner, at)])
    return df.groupBy(owner).agg(F.max(newest).alias(row)).select(owner, *[F.col(f"{row}.{c}") for c in df.columns if c not in (owner, at)], F.col(f"{row}.at").alias(at))


def stable_sort_prefix(df: DataFrame, at: str, position: str, n: int) -> DataFrame:
    """Newest first, a missing time counting as 0, equal times in their given order."""
    return df.orderBy(F.coalesce(F.col(at), F.lit(0)).desc(), F.col(position).asc()).limit(n)
