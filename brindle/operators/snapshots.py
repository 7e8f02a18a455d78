"""Mutations as functions of a snapshot: old rows and a change in, new rows out. Nothing is changed in place.

``Change`` also holds the rows that changed, for the forms that return them or count them. ``publish`` swaps a written
snapshot in by two renames of folders; see there for what a crash between them leaves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.predicates import unique_where, where
from brindle.operators.paging import orders, sort_column


@dataclass
class Change:
    rows: DataFrame
    changed: DataFrame

    def count(self) -> DataFrame:
        return self.changed.agg(F.count("*").alias("count"))


def increment(c: str, n: Any) -> Column:
    return F.col(c) + n


def decrement(c: str, n: Any) -> Column:
    return F.col(c) - n


def multiply(c: str, n: Any) -> Column:
    return F.col(c) * n


def divide(c: str, n: int) -> Column:
    """Whole numbers are divided towards zero."""
    return F.expr(f"`{c}` div {int(n)}")


def push(c: str, *items: Any) -> Column:
    return F.concat(F.coalesce(F.col(c), F.array().cast("array<string>")), F.array(*[F.lit(i) for i in items]))


def _as_column(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def create_many(rows: DataFrame, new: DataFrame, unique: Sequence[Sequence[str]] = (), skip_duplicates: bool = False, position: str | None = None) -> Change:
    """skip_duplicates drops new rows that meet an old row, or an earlier new one, in any unique key. Nulls never meet."""
    if skip_duplicates:
        for key in unique:
            filled = ~F.array_contains(F.array(*[F.col(k).isNull() for k in key]), True)
            first = Window.partitionBy(*key).orderBy(position or key[0])
            left = new.filter(filled).join(rows.select(*key), list(key), "left_anti").withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
            new = left.select(*new.columns).unionByName(new.filter(~filled))
    new = new.select(*rows.columns)
    return Change(rows.unionByName(new), new)


def create(rows: DataFrame, values: dict[str, Any]) -> Change:
    one = rows.sparkSession.range(1).select(*[_as_column(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema])
    return Change(rows.unionByName(one), one)


def _capped(rows: DataFrame, spec: dict | None, limit: int | None, order_by: Sequence, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    hit = F.coalesce(where(spec), F.lit(False))
    if limit is None:
        return rows, hit
    first = rows.filter(hit).orderBy(*[sort_column(o) for o in orders(order_by, keys)]).limit(limit).select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_hit"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    return rows.join(first, on, "left").drop(*[f"_{k}" for k in keys]), F.coalesce(F.col("_hit"), F.lit(False))


def update_many(rows: DataFrame, spec: dict | None, data: dict[str, Any], limit: int | None = None, order_by: Sequence = (), keys: Sequence[str] = ()) -> Change:
    marked, hit = _capped(rows, spec, limit, order_by, keys)
    new = [F.when(hit, _as_column(data[c])).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in data else F.col(c) for c in rows.columns]
    only = [_as_column(data[c]).cast(rows.schema[c].dataType).alias(c) if c in data else F.col(c) for c in rows.columns]
    return Change(marked.select(*new), marked.filter(hit).select(*only))


def update(rows: DataFrame, unique: Sequence[Sequence[str]], spec: dict, data: dict[str, Any]) -> Change:
    unique_where(spec, [tuple(k) for k in unique])
    return update_many(rows, spec, data)


def delete_many(rows: DataFrame, spec: dict | None, limit: int | None = None, order_by: Sequence = (), keys: Sequence[str] = ()) -> Change:
    marked, hit = _capped(rows, spec, limit, order_by, keys)
    return Change(marked.filter(~hit).select(*rows.columns), marked.filter(hit).select(*rows.columns))


def upsert(rows: DataFrame, incoming: DataFrame, key: Sequence[str], data: dict[str, Column]) -> Change:
    """incoming has a row per key with the columns to create it with; on a match ``data`` says what changes, with the
    incoming values as columns new_<name>."""
    renamed = incoming.select(*[F.col(c).alias(f"new_{c}") for c in incoming.columns])
    on = [F.col(k) == F.col(f"new_{k}") for k in key]
    both = rows.withColumn("_old", F.lit(True)).join(renamed, on, "full")
    old, met = F.col("_old").isNotNull(), F.col(f"new_{key[0]}").isNotNull()
    out = []
    for f in rows.schema:
        given = F.col(f"new_{f.name}") if f.name in incoming.columns else F.lit(None)
        kept = F.when(met, data[f.name]).otherwise(F.col(f.name)) if f.name in data else F.col(f.name)
        out.append(F.when(old, kept).otherwise(given).cast(f.dataType).alias(f.name))
    return Change(both.select(*out), both.filter(met).select(*out))


def cascade(deleted: DataFrame, key: str, child: DataFrame, fk: str) -> DataFrame:
    """The children that are left when their parents go."""
    return child.join(deleted.select(F.col(key).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def connect(child: DataFrame, keys: dict[str, Any], fk: str, parent_key: Any) -> Change:
    return update_many(child, keys, {fk: parent_key})


def disconnect(child: DataFrame, spec: dict, fk: str) -> Change:
    return update_many(child, spec, {fk: None})


def assign(*items: Any) -> Column:
    """A whole array in place of the old one."""
    return F.array(*[F.lit(i) for i in items])


def write_children(
    parents: DataFrame, key: str, children: DataFrame, fk: str, create: dict[str, Column] | None = None, update: tuple[dict, dict] | None = None,
    disconnect: dict | None = None, delete: dict | None = None,
) -> DataFrame:
    """Nested writes under a to-many relation: what is left of all children once those of ``parents`` are written.

    delete and disconnect take a specification of the parents' children, update a specification and new values, in this
    order; create gives columns of one new child per parent, computed from the parent's row.
    """
    mine = parents.select(F.col(key).alias("_pk"), F.lit(True).alias("_mine")).distinct()
    rows = children.join(mine, F.col(fk) == F.col("_pk"), "left")
    hit = lambda spec: F.coalesce(F.col("_mine") & where(spec), F.lit(False))
    if delete is not None:
        rows = rows.filter(~hit(delete))
    if disconnect is not None:
        rows = rows.withColumn("_off", hit(disconnect)).withColumn(fk, F.when(~F.col("_off"), F.col(fk))).withColumn("_mine", F.col("_mine") & ~F.col("_off"))
    if update is not None:
        rows = rows.withColumn("_hit", hit(update[0]))
        rows = rows.withColumns({c: F.when(F.col("_hit"), _as_column(v)).otherwise(F.col(c)).cast(children.schema[c].dataType) for c, v in update[1].items()})
    out = rows.select(*children.columns)
    if create is not None:
        values = create | {fk: F.col(key)}
        out = out.unionByName(parents.select(*[_as_column(values.get(f.name)).cast(f.dataType).alias(f.name) for f in children.schema]))
    return out


def write_parents(children: DataFrame, fk: str, parents: DataFrame, key: str, update: dict[str, Any] | None = None, create: dict[str, Column] | None = None) -> DataFrame:
    """Nested writes under a to-one relation: all parents once those of ``children`` are written.

    update gives new values of the parents that the children have; create gives the columns of a new parent, computed
    from the child's row, for each child that has none.
    """
    out = parents
    if update is not None:
        have = children.filter(F.col(fk).isNotNull()).select(F.col(fk).alias("_fk"), F.lit(True).alias("_hit")).distinct()
        out = parents.join(have, F.col(key) == F.col("_fk"), "left")
        out = out.withColumns({c: F.when(F.col("_hit"), _as_column(v)).otherwise(F.col(c)).cast(parents.schema[c].dataType) for c, v in update.items()}).select(*parents.columns)
    if create is not None:
        new = children.filter(F.col(fk).isNull()).select(*[_as_column(create.get(f.name)).cast(f.dataType).alias(f.name) for f in parents.schema])
        out = out.unionByName(new)
    return out


def publish(spark: SparkSession, rows: DataFrame, path: str, batch: str) -> None:
    """Write the snapshot beside ``path`` and swap it in. A batch that is already in place is not written again.

    Between the two renames ``path`` is missing, and a crash there leaves it so, with both snapshots beside it under
    their batch's names; to publish the batch again puts it in place. Half a snapshot is never seen.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    mark = f"_batch_{batch}"
    if fs.exists(at(f"{path}/{mark}")):
        return
    new, old = f"{path}.new-{batch}", f"{path}.old-{batch}"
    rows.write.mode("overwrite").parquet(new)
    fs.create(at(f"{new}/{mark}")).close()
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and batch of every snapshot that was published, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/pointers")
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return []
    named = spark.read.text(f"{path}/pointers").select(F.element_at(F.split(F.input_file_name(), "/"), -1).cast("int").alias("n"), "value")
    return sorted((r.n, r.value) for r in named.collect())


def publish_version(spark: SparkSession, rows: DataFrame, path: str, batch: str) -> None:
    """Write the snapshot under its batch's name, then point to it: readers see the old one or the new one, never none.

    A pointer is a small new file whose name is the next number, so nothing is renamed or replaced, on any store; of two
    writers that point at once the second gets an error and publishes again. A batch that is pointed to is not written again.
    """
    before = _pointers(spark, path)
    if any(b == batch for _, b in before):
        return
    rows.write.mode("overwrite").parquet(f"{path}/versions/{batch}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/pointers/{max([n for n, _ in before], default=0) + 1}")
    out = at.getFileSystem(conf).create(at, False)
    out.write(bytearray(batch.encode()))
    out.close()


def current_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The snapshot that was pointed to last; no rows before the first."""
    found = _pointers(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/versions/{found[-1][1]}") if found else spark.createDataFrame([], schema)
