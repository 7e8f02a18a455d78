"""Near vectors at scale: pairs, clusters, and clusters that grow round by round. Nearness is the cosine.

All pairs that can matter are compared, as products of matrices in cells of bounded size, in double precision where single
leaves a doubt; so nothing is missed. What bounds the work: equal blocks and pieces of time for pairs; for components, that
pairs which are linked already need no comparison. ``bands`` gives the numbers of a random-hyperplane index: at low
cosines its tables outgrow the rows (some thousands at 0.4 and half a million rows), which is why it isn't used here.

Components are labels: the smallest id that links reach. Nulls: rows without vector, with a null or a non-finite component
or of length zero take no part in pairs and are clusters of their own. Ids are unique and not null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.stored import stored

SEED = 20_240_101
#: Rows of a side of a cell and of a tile of it, at most.
CELL, TILE = 16_384, 2_048


def bands(rows: int, least: float, recall: float = 0.999, bucket: int = 64) -> tuple[int, int]:
    """bits so that a bucket of unlike vectors holds about ``bucket`` of them, and the tables that the recall needs."""
    bits = min(24, max(1, math.ceil(math.log2(max(2, rows / bucket)))))
    p = 1 - math.acos(min(1.0, max(-1.0, least))) / math.pi
    return bits, 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p**bits)))


def usable(vector: Column) -> Column:
    """Not null, finite, not all zeros."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of unit length."""
    v = _matrix(column)
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=0.0)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _tiles(a: np.ndarray, b: np.ndarray, least: float, unit: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of two matrices tile by tile: rows i of a and j of b that may have this product, and which of them are too close
    to ``least`` to tell. Products of unit vectors are first taken in single precision, whose error is below the margin."""
    x, y = (a.astype(np.float32), b.astype(np.float32)) if unit else (a, b)
    size = float(np.sqrt((a * a).sum(axis=1).max(initial=0.0) * (b * b).sum(axis=1).max(initial=0.0)))
    margin = (a.shape[1] + 4) * (2.0**-22 if unit else 2.0**-51 * size)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            product = x[i : i + TILE] @ y[j : j + TILE].T
            at = np.flatnonzero(product.ravel() >= least - margin)
            if len(at):
                close = product.ravel()[at] < least + margin
                row, col = np.divmod(at, product.shape[1])
                yield i + row, j + col, close


def _exact(x: np.ndarray, y: np.ndarray, unit: bool) -> np.ndarray:
    """Products of rows of x and y (of their directions, if unit) in double precision, summed from the first component on."""
    out = np.empty(len(x))
    for k in range(0, len(x), TILE):
        p, q = x[k : k + TILE], y[k : k + TILE]
        total = lambda v: np.cumsum(v, axis=1)[:, -1]
        out[k : k + TILE] = total(p * q) / np.sqrt(total(p * p) * total(q * q)) if unit else total(p * q)
    return out


def _cell_rows(rows: int, groups: int) -> int:
    """Rows of a part of a cell: few enough to give that many cells, bounded, since a task holds two parts."""
    return int(min(CELL, max(1_024, rows / max(1.0, math.sqrt(2 * groups)))))


def near_pairs(
    new: DataFrame, old: DataFrame, key: str, vector: str, least: float, block: str | None = None, at: str | None = None, window_s: int | None = None, recall: float = 0.999, cosines: bool = True
) -> DataFrame:
    """new_id, old_id, similarity of all pairs with at least this cosine (or dot product), each once.

    block: only pairs that have it equal. at, window_s: only pairs whose old row is at most so many seconds older; an old row
    is in its own piece of time and the next, so no pair outside two pieces is compared. Block and piece are grouping keys; what
    has many rows is cut into parts, and each part of new rows meets each of old ones in a cell of bounded size. All pairs
    of a cell are compared, so the result is whole whatever recall is asked for.
    """
    piece = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / window_s) if at else F.lit(0).cast("bigint")
    of = F.col(block) if block else F.lit(0)
    spark = new.sparkSession

    def side(df: DataFrame, is_new: bool, pieces: Column) -> DataFrame:
        df = df.filter(usable(F.col(vector)))
        df = df.filter(F.col(block).isNotNull()) if block else df
        df = df.filter(F.col(at).isNotNull()) if at else df
        time = F.unix_micros(F.col(at).cast("timestamp")) if at else F.lit(0).cast("bigint")
        return df.select(F.col(key).alias("id"), F.col(vector).alias("v"), time.alias("t"), of.alias("of"), F.explode(pieces).alias("piece"), F.lit(is_new).alias("is_new"))

    rows = side(new, True, F.array(piece)).unionByName(side(old, False, F.array(piece, piece + 1) if at else F.array(piece)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = _cell_rows(new.count(), 4 * parts)
    many = lambda is_new: F.ceil(F.count(F.when(F.col("is_new") == is_new, 1)) / cell).cast("int")
    sizes = rows.groupBy("of", "piece").agg(many(True).alias("news"), many(False).alias("olds")).filter("news > 0 and olds > 0")
    rows = rows.join(sizes, ["of", "piece"])
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("is_new"), F.col("news")).otherwise(F.col("olds"))).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_new"), F.col("olds")).otherwise(F.col("news")) - 1)))
    rows = rows.withColumn("a", F.when(F.col("is_new"), F.col("mine")).otherwise(F.col("other"))).withColumn("b", F.when(F.col("is_new"), F.col("other")).otherwise(F.col("mine")))
    window = None if at is None else window_s * 1_000_000

    def pairs(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_new = table.column("is_new").to_numpy()
        ids, t = table.column("id").to_numpy(), table.column("t").to_numpy()
        raw = _matrix(table.column("v").combine_chunks())
        v = _vectors(table.column("v").combine_chunks()) if cosines else raw
        n, o = np.flatnonzero(is_new), np.flatnonzero(~is_new)
        found = [np.empty((0,), np.int64)], [np.empty((0,), np.int64)], [np.empty((0,))]
        for i, j, _ in _tiles(v[n], v[o], least, cosines) if len(n) and len(o) else ():
            i, j = n[i], o[j]
            keep = ids[i] != ids[j]
            if window is not None:
                keep &= (t[i] - t[j] >= 0) & (t[i] - t[j] <= window)
            i, j = i[keep], j[keep]
            s = _exact(raw[i], raw[j], cosines)
            for to, x in zip(found, (ids[i], ids[j], s), strict=True):
                to.append(x[s >= least])
        return pa.table({c: np.concatenate(x) for c, x in zip(("new_id", "old_id", "similarity"), found, strict=True)})

    cells = rows.select("of", "piece", "a", "b", "id", "v", "t", "is_new").groupBy("of", "piece", "a", "b")
    return cells.applyInArrow(pairs, "new_id bigint, old_id bigint, similarity double")


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (of each row the smallest row reached, so far) with the links i, j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _forest(least: float):
    """Of one cell: each member beside the smallest that its links reach, if it is another. Rows of part 0 and 1 make links
    across, those of part 2 (a cell of one part) among themselves; without fresh rows (all from earlier rounds) none.
    Rows that have an equal ``root`` are linked already."""

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("root")
        ids, part, fresh, root = (table.column(c).to_numpy() for c in ("id", "part", "fresh", "root"))
        raw = _matrix(table.column("v").combine_chunks())
        v = _vectors(table.column("v").combine_chunks())
        _, first, of = np.unique(root, return_index=True, return_inverse=True)
        label = first[of]
        known = label.copy()
        one = np.flatnonzero(part != 1)
        two = one if (part == 2).any() else np.flatnonzero(part == 1)
        for i, j, close in _tiles(v[one], v[two], least, True) if len(one) and len(two) else ():
            i, j = one[i], two[j]
            keep = (label[i] != label[j]) & (fresh[i] | fresh[j])
            i, j, close = i[keep], j[keep], close[keep]
            good = ~close
            good[close] = _exact(raw[i[close]], raw[j[close]], True) >= least
            label = _joined(label, i[good], j[good])
        # A link for each root that now reaches a smaller one.
        some = np.unique(known[label != known])
        return pa.table({"a": root[label[some]], "b": root[some]})

    return links


def _meet(rows: DataFrame, parts: int, least: float) -> DataFrame:
    """a, b: links of the roots of rows (id, v, fresh, root) that meet: every one with every other one."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    # A row goes to the cells of its own part with every other one, and to that of its part alone.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    low, high = F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")
    part = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("part")
    return rows.select(low, high, part, "id", "v", "fresh", "root").groupBy("low", "high").applyInArrow(_forest(least), "a bigint, b bigint")


def _across(few: DataFrame, many: DataFrame, few_parts: int, many_parts: int, least: float) -> DataFrame:
    """a, b: links of roots of few rows with many."""
    a = few.withColumn("low", F.pmod(F.xxhash64("id"), F.lit(few_parts)).cast("int")).withColumn("high", F.explode(F.sequence(F.lit(0), F.lit(many_parts - 1)))).withColumn("part", F.lit(0))
    b = many.withColumn("high", F.pmod(F.xxhash64("id"), F.lit(many_parts)).cast("int")).withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(few_parts - 1)))).withColumn("part", F.lit(1))
    both = a.unionByName(b).select("low", "high", "part", "id", "v", "fresh", "root")
    return both.groupBy("low", "high").applyInArrow(_forest(least), "a bigint, b bigint")


def _distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, v, fresh, root): one row for each vector, and the links a, b of the roots of equal vectors. Equal vectors
    without a fresh row among them make no link, so there each root keeps a row."""
    by_root = rows.groupBy("v", "root").agg(F.min("id").alias("id"), F.max("fresh").alias("fresh"))
    of_vector = by_root.groupBy("v").agg(F.min("id").alias("_id"), F.min("root").alias("_root"), F.max("fresh").alias("_fresh"))
    # With a hash before it, vectors are compared as a whole only where it is equal.
    hashed = lambda df: df.withColumn("_hash", F.xxhash64("v"))
    both = stored(hashed(by_root).join(hashed(of_vector), ["_hash", "v"]).drop("_hash"), "vectors")
    one = both.filter(~F.col("_fresh") | (F.col("id") == F.col("_id")))
    one = one.select("id", "v", F.col("_fresh").alias("fresh"), F.when(F.col("_fresh"), F.col("_root")).otherwise(F.col("root")).alias("root"))
    return one, both.filter(F.col("_fresh") & (F.col("root") != F.col("_root"))).select(F.col("_root").alias("a"), F.col("root").alias("b"))


def links(vectors: DataFrame, key: str, vector: str, least: float, fresh: Column | None = None, recall: float = 0.999, cell: int | None = None, root: Column | None = None, pivots: int = CELL) -> DataFrame:
    """a, b (ids, a < b): links that connect whatever pairs of at least this cosine connect. fresh: only pairs with a row
    for which it is true. root: what is linked already, as the smallest id; the links are then among roots.

    Equal vectors are linked by grouping, and one row of them is compared. All pairs of different roots are compared, in cells
    of bounded size, so no link is lost whatever recall is asked for. Of more than ``pivots`` vectors, first those with
    the smallest hashes meet all others; what is then in the largest component need not be compared with itself, so only
    the rest meets all. Where one component takes most vectors, or most rows are copies, work grows with the rows; where
    neither is so, with the square of the distinct vectors.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.filter(usable(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).alias("v"), (F.lit(True) if fresh is None else fresh).alias("fresh"), (F.col(key) if root is None else root).alias("root"))
    rows = stored(rows, "vectors")
    if least > 1:  # no pair has such a cosine
        return rows.select(F.col("root").alias("a"), F.col("root").alias("b")).limit(0)
    rows, equal = _distinct(rows)
    n = rows.count()
    size = cell or _cell_rows(n, 2 * parts)
    if n <= pivots:
        return stored(equal.union(_meet(rows, max(1, -(-n // size)), least)).distinct(), "links")
    # About as many pivots as asked for: a share of the hashes.
    pivot = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(n)) < pivots
    first = stored(_across(rows.filter(pivot), rows, max(1, pivots // CELL), max(1, -(-n // size)), least).union(equal).distinct(), "links")
    now = components(first).select(F.col("id").alias("_c"), F.col("root").alias("_r"))
    now = stored(rows.join(now, F.col("root") == F.col("_c"), "left").select("id", "v", "fresh", F.coalesce("_r", "root").alias("root")), "vectors")
    largest = now.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").first()["root"]
    few = stored(now.filter(F.col("root") != largest), "vectors")
    left = few.count()
    if not left:
        return first
    if 2 * left > n:
        return stored(first.union(_meet(now, max(1, -(-n // size)), least)).distinct(), "links")
    return stored(first.union(_across(few, now, max(1, -(-left // CELL)), max(1, -(-n // size)), least)).distinct(), "links")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """id, root of every id in the edges (a, b): the smallest id reached.

    Stars in turns: each id's larger neighbours are linked to its smallest one, then each id's smaller ones, until every
    component is a star around its smallest id, in rounds that grow with the logarithm of its length squared at most.
    """
    ids = stored(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "ids")
    links, before = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"), None
    for _ in range(most_rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return ids.join(links.toDF("id", "v"), "id", "left").select("id", F.coalesce("v", "id").alias("root"))
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        larger = stored(larger, "links")
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, before = stored(smaller.union(least.select("u", F.col("m").alias("v"))).distinct(), "links"), now
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def clusters(vectors: DataFrame, key: str, vector: str, least: float, recall: float = 0.999) -> DataFrame:
    """vectors with cluster: the smallest id that links of at least this cosine reach, its own without links."""
    root = components(links(vectors, key, vector, least, recall=recall)).select(F.col("id").alias("_id"), "root")
    return vectors.join(root, F.col(key) == F.col("_id"), "left").withColumn("cluster", F.coalesce("root", key)).drop("_id", "root")


def grown(known: DataFrame, new: DataFrame, key: str, vector: str, least: float, recall: float = 0.999) -> DataFrame:
    """known (with cluster) and new rows together, as clusters() of their union: links of new rows with all rows join
    clusters; links among known rows are not looked for again."""
    both = known.select(key, vector, "cluster").unionByName(new.select(key, vector, F.lit(None).cast("bigint").alias("cluster")))
    both = stored(both, "signals")
    edges = links(both, key, vector, least, F.col("cluster").isNull(), recall, root=F.coalesce("cluster", key))
    root = components(edges).select(F.col("id").alias("_c"), "root")
    now = both.withColumn("cluster", F.coalesce("cluster", key)).join(root, F.col("cluster") == F.col("_c"), "left")
    return stored(now.select(key, vector, F.coalesce("root", "cluster").alias("cluster")), "clusters")


def rounds(signals: DataFrame, round_of: str, key: str, vector: str, least: float, clusters_wanted: int = 3, size: int = 5, recall: float = 0.999) -> DataFrame:
    """Signals are gathered round after round until so many clusters have ``size`` members: key, cluster, and the round
    that was the last (all rounds, if never so many)."""
    known = None
    for (n,) in signals.select(round_of).distinct().orderBy(round_of).collect():
        part = signals.filter(F.col(round_of).eqNullSafe(F.lit(n)))
        known = grown(signals.limit(0).select(key, vector, F.lit(None).cast("bigint").alias("cluster")) if known is None else known, part, key, vector, least, recall)
        enough = known.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= size).limit(clusters_wanted).count()
        if enough >= clusters_wanted:
            break
    return known.select(key, "cluster", F.lit(n).alias("stopped_in"))
