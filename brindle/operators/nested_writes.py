"""Nested writes that find or make rows: connectOrCreate, upsert and createMany under a relation, all as joins of tables.

Under a to-many relation the wanted rows are children with their key and the parent they are for; under a to-one relation
each child names the parent it wants. Of wanted rows with one key the first by ``position`` counts, found by an aggregate, so
a key that many want meets in no single task. Wanted rows with a null key are always made, as nulls are equal to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.snapshots import Change


def _first(wanted: DataFrame, key: str, position: str) -> DataFrame:
    rest = [c for c in wanted.columns if c != key]
    named = wanted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), position).alias("_r"))
    return named.select(key, "_r.*").select(*wanted.columns).unionByName(wanted.filter(F.col(key).isNull()))


def _matched(children: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """All children and all wanted rows, the latter's columns as _w_<name>; _old and _new say which are there."""
    new = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in wanted.columns], F.lit(True).alias("_new"))
    return children.withColumn("_old", F.lit(True)).join(new, F.col(key) == F.col(f"_w_{key}"), "full")


def _made(both: DataFrame, children: DataFrame, wanted: DataFrame, data: dict[str, Column], hit: Column) -> Change:
    """Old children with data where hit; wanted rows that met none as new children."""
    given = {c: F.col(f"_w_{c}") for c in children.columns if c in wanted.columns}
    out = []
    for f in children.schema:
        old = F.when(hit, data[f.name]).otherwise(F.col(f.name)) if f.name in data else F.col(f.name)
        out.append(F.when(F.col("_old"), old).otherwise(given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name))
    return Change(both.select(*out), both.filter(F.col("_old").isNull() | hit).select(*out))


def connect_or_create(children: DataFrame, wanted: DataFrame, key: str, fk: str, position: str) -> Change:
    """A child that is there gets the parent of the wanted row, whosever it was, and is else left as it is; one that isn't
    is made of the wanted row."""
    wanted = _first(wanted, key, position)
    hit = F.col("_old") & F.coalesce("_new", F.lit(False))
    return _made(_matched(children, wanted, key), children, wanted, {fk: F.col(f"_w_{fk}")}, hit)


def upsert(children: DataFrame, wanted: DataFrame, key: str, fk: str, data: dict[str, Column], position: str) -> Change:
    """A child of the wanted row's parent gets new values (data, with wanted values as _w_<name>), one that isn't there is
    made; another parent's child of that key is left alone, and none is made, as its key is taken."""
    wanted = _first(wanted, key, position)
    hit = F.col("_old") & F.coalesce(F.col("_new") & F.col(fk).eqNullSafe(F.col(f"_w_{fk}")), F.lit(False))
    return _made(_matched(children, wanted, key), children, wanted, data, hit)


def create_many(children: DataFrame, rows: DataFrame, key: str, fk: str, parents: DataFrame, parent_key: str, position: str, skip_duplicates: bool = False) -> Change:
    """The rows whose parent is there, as its children. skip_duplicates leaves out keys that are taken, also by an earlier
    of the rows; without it they are written and the caller sees to uniqueness."""
    ours = rows.join(parents.select(F.col(parent_key).alias("_p")).distinct(), F.col(fk) == F.col("_p"), "left_semi")
    if skip_duplicates:
        ours = _first(ours, key, position)
        ours = ours.join(children.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    new = ours.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in children.schema])
    return Change(children.unionByName(new), new)


def connect_or_create_parent(children: DataFrame, child_key: str, fk: str, parents: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """children, parents. wanted has one row per child (_child, and columns of a parent): the child gets the parent of that
    key; of the children that want one that isn't there, that with the smallest key gives its values."""
    asked = wanted.select("_child", F.col(key).alias("_pk"))
    out = children.join(asked, F.col(child_key) == F.col("_child"), "left")
    fks = F.coalesce("_pk", fk).cast(children.schema[fk].dataType).alias(fk)
    out = out.select(*[fks if c == fk else F.col(c) for c in children.columns])
    asked_by = wanted.join(children.select(F.col(child_key).alias("_c")), F.col("_child") == F.col("_c"), "left_semi").filter(F.col(key).isNotNull())
    new = _first(asked_by, key, "_child").join(parents.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    made = new.select(*[(F.col(f.name) if f.name in wanted.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in parents.schema])
    return out, parents.unionByName(made)


def upsert_parent(children: DataFrame, fk: str, parents: DataFrame, key: str, update: dict[str, Column], create: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """children, parents. The parents that the children have get new values; a child without one gets a new parent, with
    ``create`` computed from the child's row and its key as the child's."""
    have = children.filter(F.col(fk).isNotNull()).select(F.col(fk).alias("_fk"), F.lit(True).alias("_hit")).distinct()
    kept = parents.join(have, F.col(key) == F.col("_fk"), "left")
    kept = kept.select(*[(F.when(F.col("_hit"), update[f.name]).otherwise(F.col(f.name)) if f.name in update else F.col(f.name)).cast(f.dataType).alias(f.name) for f in parents.schema])
    alone = children.filter(F.col(fk).isNull())
    made = alone.select(*[create.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in parents.schema])
    linked = F.coalesce(F.col(fk), create[key]).cast(children.schema[fk].dataType).alias(fk)
    return children.select(*[linked if c == fk else F.col(c) for c in children.columns]), kept.unionByName(made)
