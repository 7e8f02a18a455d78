"""Shared helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import shared_dir

#: A word is a run of anything but space and the five control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    """Array of the words of a text; empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda.

    A column that only a lambda of a later projection uses would be merged into that lambda and computed per element.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def n_words(text: str | Column) -> Column:
    """Number of words of a text, 0 for null: white-space runs of the trimmed text, plus one."""
    text = F.col(text) if isinstance(text, str) else text
    return F.size(words(text)).cast("long")


def text_hash(text: str | Column) -> Column:
    """64-bit hash of a text that tells null from empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(text, F.lit("\x00null")))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that df has a column of, in upper or lower case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_by_weight(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, share: int = 10_000) -> DataFrame:
    """Inner join of left with right, a written table of one row per key that holds the key's number of left rows in weight.

    Keys with over 1 / share of the rows, which are fewer than ``share``, go to the tasks of left by broadcast; the rest
    is shuffled, so no task gets more than that share of one key. Key columns hold no nulls.
    """
    keys = [key] if isinstance(key, str) else key
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * share > total
    if right.filter(hot).isEmpty():
        return left.join(right, keys)
    few = F.broadcast(right.filter(hot))
    rest = left.join(few.select(*keys), keys, "left_anti").join(right.filter(~hot), keys)
    return left.join(few, keys).unionByName(rest)


def repeated(df: DataFrame, times: str, number: str, chunk: int = 100_000) -> DataFrame:
    """Rows of df, a written table, each as often as its column times (a bigint, 1 or more) says, with number (from 1) in its place.

    A row to repeat more than ``chunk`` times is first dealt to many tasks, ``chunk`` copies each.
    """
    upto = F.least(F.col(times), (F.col(number) + 1) * chunk)
    often = df.filter(F.col(times) > chunk).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / chunk))))
    often = often.repartition(shuffle_partitions(df.sparkSession)).withColumn(number, F.explode(F.sequence(F.col(number) * chunk + 1, upto)))
    once = df.filter(F.col(times) <= chunk).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return once.unionByName(often).drop(times)


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor loses none of them.

    drop() removes those that no returned frame reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._brindle_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, df._brindle_path)


def delete(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
