"""Extensions of a client over tables: computed fields, hooks around reads, and own operations, in the order they were added.

An extension never changes the client it extends; ``extend`` gives a new one. Fields are columns that Catalyst prunes when
nothing asks for them, hooks rewrite the arguments of a read or its result, so all of it stays one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame

from brindle.operators.paging import find_many

#: A hook gets the table's name, the arguments of the read, and (as ``on``) what to call on.
Hook = Callable[..., DataFrame]


@dataclass(frozen=True)
class Extension:
    """fields: by table, columns by name, computed from the table's columns and fields added before. hooks: by table, or
    "*" for all. operations: by table (or "*"), functions of the table's rows and what they are called with."""

    fields: Mapping[str, Mapping[str, Column]] = field(default_factory=dict)
    hooks: Mapping[str, Hook] = field(default_factory=dict)
    operations: Mapping[str, Mapping[str, Callable[..., Any]]] = field(default_factory=dict)


@dataclass(frozen=True)
class Client:
    tables: Mapping[str, DataFrame]
    keys: Mapping[str, Sequence[str]]
    extensions: tuple[Extension, ...] = ()

    def extend(self, *more: Extension) -> Client:
        return replace(self, extensions=(*self.extensions, *more))

    def rows(self, table: str) -> DataFrame:
        """The table with its computed fields; a field that has a column's name replaces it."""
        out = self.tables[table]
        for e in self.extensions:
            for name, column in e.fields.get(table, {}).items():
                out = out.withColumn(name, column)
        return out

    def find_many(self, table: str, **asked: Any) -> DataFrame:
        """A read by paging.find_many (filter, order_by, cursor, distinct, skip, take, select, omit), computed fields included.
        Hooks run around it, the last added outermost; each may change what is asked before it calls on, or the rows after."""

        def call(args: dict) -> DataFrame:
            return find_many(self.rows(table), self.keys[table], **args)

        for e in self.extensions:
            for name in (table, "*"):
                if hook := e.hooks.get(name):
                    call = partial(hook, table, on=call)
        return call(asked)

    def call(self, table: str, operation: str, *args: Any, **named: Any) -> Any:
        """An own operation; of several of one name the last added."""
        for e in reversed(self.extensions):
            for name in (table, "*"):
                if f := e.operations.get(name, {}).get(operation):
                    return f(self.rows(table), *args, **named)
        raise AttributeError(f"{table} has no operation {operation}")
