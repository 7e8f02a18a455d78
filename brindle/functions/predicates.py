"""Filter algebra: nested specifications compiled to one Column.

A specification maps a column to a value (equality) or to a dict of operators, and may hold AND, OR and NOT with lists
of specifications. None is a condition (the column is null); UNSET is no condition. SQL's three-valued logic holds: a
row whose condition is unknown is not selected, and NOT of unknown stays unknown.

Scalars: equals, not, in, notIn, lt, lte, gt, gte, contains, startsWith, endsWith, mode ("insensitive" for the text
operators and equality). Arrays: equals, has, hasEvery, hasSome, isEmpty. JSON text: path (list of keys) with equals, not,
string_contains, string_starts_with, string_ends_with, array_contains, array_starts_with, array_ends_with, lt, lte, gt,
gte. A value may be a Field, to compare with another column of the row.

JSON values are typed: the number 1 is neither the text "1" nor true. There are three kinds of null at a path: nothing
there (DB_NULL), a JSON null (JSON_NULL), either (ANY_NULL). array_contains takes one value or a list, all of which must be
in the array; order conditions compare numbers with numbers and texts with texts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No condition, unlike None.
UNSET = object()
#: The kinds of null of a JSON column: SQL NULL, the JSON literal null, either.
DB_NULL, JSON_NULL, ANY_NULL = "db_null", "json_null", "any_null"


@dataclass(frozen=True)
class Field:
    """Another column of the same row."""

    name: str


@dataclass(frozen=True)
class Json:
    """Operators on a JSON text column, at a path of keys."""

    ops: dict
    path: tuple = ()


def _value(v: Any) -> Column:
    return F.col(v.name) if isinstance(v, Field) else F.lit(v)


def _like(ops: dict, c: Column, v: Any) -> tuple[Column, Column]:
    v = _value(v)
    return (F.lower(c), F.lower(v)) if ops.get("mode") == "insensitive" else (c, v)


def _one(c: Column, op: str, v: Any, ops: dict) -> Column:
    if op == "equals":
        return c.isNull() if v is None else (lambda ab: ab[0] == ab[1])(_like(ops, c, v) if isinstance(v, str) else (c, _value(v)))
    if op == "not":
        if v is None:
            return c.isNotNull()
        return ~(condition(c, v) if isinstance(v, dict) else _one(c, "equals", v, ops))
    if op in ("in", "notIn"):
        found = c.isin(list(v)) if v else F.when(c.isNotNull(), F.lit(False))
        return found if op == "in" else ~found
    if op in ("lt", "lte", "gt", "gte"):
        b = _value(v)
        return {"lt": c < b, "lte": c <= b, "gt": c > b, "gte": c >= b}[op]
    if op in ("contains", "startsWith", "endsWith"):
        a, b = _like(ops, c, v)
        return {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[op](a, b)
    if op == "has":
        return F.array_contains(c, v)
    if op == "hasEvery":
        return F.when(c.isNotNull(), F.size(F.array_except(F.array(*[F.lit(x) for x in v]), c)) == 0) if v else c.isNotNull()
    if op == "hasSome":
        return F.arrays_overlap(c, F.array(*[F.lit(x) for x in v])) if v else F.when(c.isNotNull(), F.lit(False))
    if op == "isEmpty":
        empty = F.when(c.isNotNull(), F.size(c) == 0)
        return empty if v else ~empty
    raise ValueError(f"unknown operator {op!r}")


def condition(c: Column, ops: Any) -> Column:
    """One column against a bare value or a dict of operators."""
    if isinstance(ops, Json):
        return json_condition(c, ops)
    if not isinstance(ops, dict):
        return F.lit(True) if ops is UNSET else _list_or_equal(c, ops)
    each = [_list_or_equal(c, v) if op == "equals" and isinstance(v, list) else _one(c, op, v, ops) for op, v in ops.items() if op != "mode" and v is not UNSET]
    return reduce(and_, each, F.lit(True))


def _list_or_equal(c: Column, v: Any) -> Column:
    return c == F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else _one(c, "equals", v, {})


def json_at(c: Column, path: tuple = ()) -> Column:
    """The typed value (VARIANT) at a path of a JSON text: SQL null where the text, or the path in it, is missing or the
    text is malformed; a JSON null is a value."""
    steps = []
    for k in path:
        if not isinstance(k, int) and "'" in k and '"' in k:
            raise ValueError(f"a key with both kinds of quotes: {k!r}")
        steps.append(f"[{k}]" if isinstance(k, int) else f'["{k}"]' if "'" in k else f"['{k}']")
    v = F.try_parse_json(c)
    return F.try_variant_get(v, "$" + "".join(steps), "variant") if path else v


def _kind(v: Column) -> Column:
    """BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, VOID (a JSON null), ARRAY or OBJECT."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _got(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def json_equals(v: Column, value: Any, ops: dict) -> Column:
    """Equality of JSON values: of one kind, numbers by size, objects whatever the order of their keys."""
    if value is None:
        return F.is_variant_null(v)
    if isinstance(value, bool):
        return (_kind(v) == "BOOLEAN") & (_got(v, "boolean") == value)
    if isinstance(value, int):
        return F.when(_kind(v) == "BIGINT", _got(v, "bigint") == value).otherwise(_kind(v).isin("DECIMAL", "DOUBLE") & (_got(v, "double") == float(value)))
    if isinstance(value, float):
        return _kind(v).isin("BIGINT", "DECIMAL", "DOUBLE") & (_got(v, "double") == value)
    if isinstance(value, str):
        return (_kind(v) == "STRING") & _one(_got(v, "string"), "equals", value, ops)
    other = json_at(F.col(value.name)) if isinstance(value, Field) else F.parse_json(F.lit(json.dumps(value)))
    numbers = _kind(v).isin("BIGINT", "DECIMAL", "DOUBLE") & _kind(other).isin("BIGINT", "DECIMAL", "DOUBLE")
    return F.when(other.isNotNull(), F.when(numbers, _got(v, "double") == _got(other, "double")).otherwise(F.to_json(v) == F.to_json(other)))


def json_null(c: Column, kind: str, path: tuple = ()) -> Column:
    """Nothing there (no row value or no such path), a JSON null there, or either."""
    v = json_at(c, path)
    missing, is_json_null = (v if path else c).isNull(), F.coalesce(F.is_variant_null(v), F.lit(False))
    return {DB_NULL: missing, JSON_NULL: is_json_null, ANY_NULL: missing | is_json_null}[kind]


def _holds(items: Column, value: Any, ops: dict) -> Column:
    return F.exists(items, lambda x: json_equals(x, value, ops))


def _json_one(v: Column, op: str, value: Any, ops: dict) -> Column:
    items = F.when(_kind(v) == "ARRAY", _got(v, "array<variant>"))
    if op == "equals":
        return json_equals(v, value, ops)
    if op == "not":
        return ~json_equals(v, value, ops)
    if op.startswith("string_"):
        return (_kind(v) == "STRING") & _one(_got(v, "string"), {"contains": "contains", "starts_with": "startsWith", "ends_with": "endsWith"}[op[7:]], value, ops)
    if op == "array_contains":
        wanted = value if isinstance(value, list) else [value]
        return reduce(and_, [_holds(items, w, ops) for w in wanted], items.isNotNull())
    if op in ("array_starts_with", "array_ends_with"):
        return json_equals(F.try_element_at(items, F.lit(1 if op == "array_starts_with" else -1)), value, ops)
    if op in ("lt", "lte", "gt", "gte"):
        if isinstance(value, str):
            return (_kind(v) == "STRING") & _one(_got(v, "string"), op, value, ops)
        return _kind(v).isin("BIGINT", "DECIMAL", "DOUBLE") & _one(_got(v, "double"), op, float(value), ops)
    raise ValueError(f"unknown operator {op!r}")


def json_condition(c: Column, spec: Json) -> Column:
    """Unknown where there is no value at the path (but for the kinds of null); false where the value is of another kind."""
    v, out = json_at(c, spec.path), []
    for op, value in spec.ops.items():
        if op == "mode" or value is UNSET:
            continue
        if isinstance(value, str) and value in (DB_NULL, JSON_NULL, ANY_NULL) and op in ("equals", "not"):
            found = json_null(c, value, spec.path)
            out.append(found if op == "equals" else ~found)
        else:
            out.append(F.when(v.isNotNull(), F.coalesce(_json_one(v, op, value, spec.ops), F.lit(False))))
    return reduce(and_, out, F.lit(True))


def where(spec: dict | None) -> Column:
    """A whole specification. AND of nothing is true, OR of nothing false, NOT of nothing true."""
    out = []
    for key, v in (spec or {}).items():
        if v is UNSET:
            continue
        some = [where(s) for s in (v if isinstance(v, list) else [v])] if key in ("AND", "OR", "NOT") else []
        if key == "AND":
            out.append(reduce(and_, some, F.lit(True)))
        elif key == "OR":
            out.append(reduce(or_, some, F.lit(False)))
        elif key == "NOT":
            out.append(reduce(and_, [~s for s in some], F.lit(True)))
        else:
            out.append(condition(F.col(key), v))
    return reduce(and_, out, F.lit(True))


def unique_where(spec: dict, keys: list[tuple[str, ...]]) -> Column:
    """A specification that must name a whole unique key with plain values, whatever else it holds."""
    named = {k for k, v in spec.items() if v is not UNSET and v is not None and not isinstance(v, dict)}
    if not any(set(k) <= named for k in keys):
        raise ValueError(f"needs one of the unique keys {keys}")
    return where(spec)
