"""Aggregates: filtered and windowed global ones, groups with conditions on aggregates, and ordered enums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.predicates import where
from brindle.operators.paging import find_many, sort_column

ORDERED = {"sum", "avg", "min", "max"}


def name_of(fn: str, column: str) -> str:
    return "n" if column == "*" else f"{fn}_{column}"


def aggregate_columns(**wanted: Sequence[str]) -> list[Column]:
    """count=["*", "a"], sum=[...], avg=[...], min=[...], max=[...]; columns are named sum_a, and n for count of rows."""
    fns = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    return [fns[fn]("*" if c == "*" else F.col(c)).alias(name_of(fn, c)) for fn, cs in wanted.items() for c in cs]


def count_where(df: DataFrame, spec: dict | None = None, name: str = "n") -> DataFrame:
    return df.filter(where(spec)).agg(F.count("*").alias(name))


def aggregate(df: DataFrame, keys: Sequence[str], wanted: dict[str, Sequence[str]], **query) -> DataFrame:
    """Aggregates of the rows that a query leaves: cursor, skip and take come first."""
    rows = find_many(df, keys, **query) if set(query) - {"filter"} else df.filter(where(query.get("filter")))
    return rows.agg(*aggregate_columns(**wanted))


def plain_keys(having: dict | None, outputs: set[str]) -> set[str]:
    out: set[str] = set()
    for k, v in (having or {}).items():
        out |= set().union(*[plain_keys(s, outputs) for s in (v if isinstance(v, list) else [v])]) if k in ("AND", "OR", "NOT") else ({k} - outputs)
    return out


def group_by(
    df: DataFrame, by: Sequence[str], wanted: dict[str, Sequence[str]], filter: dict | None = None, having: dict | None = None,
    order_by: Sequence[tuple] = (), skip: int = 0, take: int | None = None,
) -> DataFrame:
    """having names keys of ``by`` or aggregates (sum_a, n), whether or not they are in ``wanted``; null is a group."""
    if not by:
        raise ValueError("by must not be empty")
    if (skip or take is not None) and not order_by:
        raise ValueError("skip and take need order_by")
    columns = {name_of(fn, c) for fn in (*ORDERED, "count") for c in [*df.columns, "*"]}
    used = plain_keys(having, set()) | {o[0] for o in order_by}
    if bad := {k for k in used if k not in by and k not in columns}:
        raise ValueError(f"not in by: {sorted(bad)}")
    shown = [name_of(fn, c) for fn, cs in wanted.items() for c in cs]
    extra: dict[str, list[str]] = {}
    for k in used - set(by) - set(shown):
        fn, _, c = ("count", "", "*") if k == "n" else k.partition("_")
        extra.setdefault(fn, []).append(c)
    everything = {fn: [*wanted.get(fn, []), *extra.get(fn, [])] for fn in {**wanted, **extra}}
    out = df.filter(where(filter)).groupBy(*by).agg(*aggregate_columns(**everything)).filter(where(having))
    if order_by:
        out = out.orderBy(*[sort_column((*o, None)[:3]) for o in order_by], *[F.col(k).asc_nulls_last() for k in by])
    out = out.offset(skip) if skip else out
    out = out.limit(take) if take is not None else out
    return out.select(*by, *shown)


def group_problem(by: Column, used: Column, aggregates: Sequence[str], paged: Column, ordered: Column) -> Column:
    """The rules of group_by() for requests that are rows: the first that a request breaks, null if none.

    by: its keys; used: the names in its having and order; aggregates: names that may be used without being keys.
    """
    other = F.array_sort(F.array_except(F.array_except(used, by), F.array(*[F.lit(a) for a in aggregates])))
    return (
        F.when(F.size(by) == 0, "by must not be empty").when(paged & ~ordered, "skip and take need order_by")
        .when(F.size(other) > 0, F.concat(F.lit("not in by: "), F.array_join(other, ", ")))
    )


def ordinal(c: Column, values: Sequence[str]) -> Column:
    """The place of an enum value in its declared order, null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), c), F.lit(0))


def enum_min(c: str, values: Sequence[str]) -> Column:
    return F.min_by(F.col(c), ordinal(F.col(c), values))


def enum_max(c: str, values: Sequence[str]) -> Column:
    return F.max_by(F.col(c), ordinal(F.col(c), values))


def distinct_last_wins(df: DataFrame, key: Sequence[str], position: str) -> DataFrame:
    """One row per key: the first position of the key, the other values of its last row."""
    rest = [c for c in df.columns if c not in (*key, position)]
    last = F.max_by(F.struct(*rest), F.col(position)) if rest else F.lit(None)
    out = df.groupBy(*key).agg(F.min(position).alias(position), last.alias("_last"))
    return out.select(*key, position, *[F.col(f"_last.{c}").alias(c) for c in rest])
