"""Packing documents into padded batches by optimal length buckets.

A bucket holds the documents of a range of lengths; each is padded to the bucket's upper bound. Given how often each
length occurs over the whole corpus, dynamic programming chooses at most ``max_buckets`` bounds with the least padding
in total. Within a bucket, documents in a fixed pseudo-random order fill batches of ``token_budget`` padded tokens.

The histogram has a row for each length that occurs, and it alone goes through the driver. D different lengths make up
at least D * D / 2 tokens, so a corpus of T tokens has at most sqrt(2 * T) of them: 6 million for 100 TB at the very most.
Every document is placed: one longer than the budget has a batch of its own.

Places within a bucket are numbered without gathering it: each bucket is split into shards by hash, documents are
numbered inside their shard and a shard begins where those before it end.

Defined cases: null and empty texts have length 0 and go to batches of the shortest bucket (padded like any other); if
every text is empty, the one bucket has bound 1. Of a very long text only its length is used. Equal rows are separate documents. An empty table gives no batches.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, n_words, repeated, shuffle_partitions, text_hash


def best_bounds(lengths: np.ndarray, counts: np.ndarray, max_buckets: int) -> list[int]:
    """Upper bounds of at most max_buckets buckets that minimise sum(count * (bound - length)); lengths are ascending.

    cost[j]: least padded total of the j shortest lengths. A bucket from i on adds lengths[j - 1] * (c[j] - c[i]), so the
    best i is that of the lowest line with slope -c[i] at lengths[j - 1]; lines and lengths come in order, and a lower
    envelope gives each bucket in time linear in the lengths. Whole numbers throughout, so the optimum is exact.
    """
    n, at = len(lengths), [int(x) for x in lengths]
    if n == 0:
        return []
    c = [0, *(int(x) for x in np.cumsum(counts.astype(np.int64)))]
    cost, splits = [0, *(at[j] * c[j + 1] for j in range(n))], []
    for _ in range(1, min(max_buckets, n)):
        new, split, hull, low = [0] * (n + 1), np.zeros(n + 1, np.int64), [], 0
        for j in range(1, n + 1):
            i = j - 1
            while len(hull) - low >= 2:
                x, y = hull[-2], hull[-1]
                if (cost[i] - cost[x]) * (c[y] - c[x]) > (cost[y] - cost[x]) * (c[i] - c[x]):
                    break
                hull.pop()
            hull.append(i)
            here = at[j - 1]
            while len(hull) - low >= 2 and cost[hull[low + 1]] - here * c[hull[low + 1]] <= cost[hull[low]] - here * c[hull[low]]:
                low += 1
            new[j], split[j] = cost[hull[low]] + here * (c[j] - c[hull[low]]), hull[low]
        splits.append(split)
        cost = new
    j, bounds = n, []
    for split in reversed(splits):
        bounds.append(at[j - 1])
        j = int(split[j])
        if j == 0:
            return bounds[::-1]
    return [at[j - 1], *bounds[::-1]]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    max_buckets: int = 16,
    token_budget: int = 65_536,
    shard_rows: int = 100_000,
    seed: int = 0,
) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, bucket (from 0), padded_to, batch (from 0 in its bucket), place (from 0).

    length: tokens of a row; the number of words of text_col if not given.
    """
    spark: SparkSession = docs.sparkSession
    n = n_words(text_col) if length is None else length
    rows = docs.select(F.col(id_col).alias("_id"), text_hash(text_col).alias("_th"), F.coalesce(n, F.lit(0)).cast("long").alias("_n"))
    # Equal rows are counted, then numbered, so that no number of them meets in one shard.
    rows = Scratch(spark, "packing").write(rows.groupBy("_id", "_th", "_n").agg(F.count("*").alias("_times")), "lengths")
    counted = rows.groupBy(F.greatest("_n", F.lit(1)).alias("length")).agg(F.sum("_times").alias("count")).toArrow().sort_by("length")
    lengths, counts = counted.column("length").to_numpy(), counted.column("count").to_numpy()
    bounds = best_bounds(lengths, counts, max_buckets) or [1]

    bound = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(bound, lambda b: b < F.col("_n")))
    shards = max(4 * shuffle_partitions(spark), -(-int(counts.sum()) // shard_rows))
    rows = repeated(rows, "_times", "_twin")
    rows = rows.select("_id", "_th", "_twin", "_n", bucket.alias("bucket"), F.pmod(F.xxhash64("_id", "_th", "_twin", F.lit(seed)), F.lit(shards)).cast("int").alias("_shard"))
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.groupBy("bucket", "_shard").count().select("bucket", "_shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    place = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy(F.xxhash64("_id", "_th", "_twin", F.lit(seed + 1)), "_id", "_n")) - 1
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("padded_to")).cast("long"))
    return (
        rows.withColumn("_place", place)
        .join(begins, ["bucket", "_shard"])
        .select("_id", "_n", "bucket", F.element_at(bound, F.col("bucket") + 1).alias("padded_to"), (F.col("_from") + F.col("_place")).cast("long").alias("_at"))
        .select(
            F.col("_id").alias(id_col),
            F.col("_n").alias("n_tokens"),
            "bucket",
            "padded_to",
            F.floor(F.col("_at") / per_batch).cast("long").alias("batch"),
            (F.col("_at") % per_batch).cast("long").alias("place"),
        )
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
