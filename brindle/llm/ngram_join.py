"""Jaccard join on word n-grams by count vectors and R-trees.

Two texts link when their sets of distinct word 5-grams (ASCII letters in lower case) have a Jaccard similarity of at
least 0.8. The join finds every component of links:

1. Equal sets become one class, known by a 128-bit hash of its set folded to 64 bits.
2. Each class gets a count vector: its n-grams are hashed into ``GROUPS`` groups and counted. The overlap of two sets
   is at most the sum of the smaller counts of each group; a similarity of t needs t / (1 + t) of both sizes together.
3. Blocks cut the join into tasks and lose no link: two sets with the similarity share an n-gram among the first
   ``n - ceil(t n) + 1`` of each under any one order. The order is rare first, by counts over the whole corpus in
   2**18 buckets, so that common passages come last. The blocks with one smallest member, their lead, are one family:
   its members are those of any of its blocks, once each, so that a pair is met once a family and not once a block.
4. Each family has an R-tree over its members' count vectors (nodes hold the greatest counts and the least and greatest
   sizes below them). A descent cuts off what a bound rules out, and the members that pass are candidate pairs; every
   pair that is verified on the whole sets comes out of such a tree. First each tree is asked for its family's lead.
5. Then, where a family's members still are in different components, its tree is joined with itself: twice, first with
   the ``first_best`` likeliest partners of each member, whose links join most of what belongs together, then with all
   pairs still in different components; no pair is verified twice. A family of more than ``block_rows`` members is cut
   into chunks: each is asked for the lead, and each pair of chunks is a cell of its own.

Pairs are tested against whole sets, cut from the texts again, so nothing of a set's size is stored for all documents.
The text of a class is found by its smallest (doc_id, text hash), null safe, so texts under null ids link like any other.
Classes, blocks and families that hold more than 1/10,000 of all rows are joined by broadcast, the others by shuffle.

Defined cases: an empty table gives no rows. A null text, or one without words, has no n-grams, size 0, and is its own component. A text of one to
four words has its whole word sequence as one n-gram. A very long text has all its n-grams in one set. Rows with one id and different texts are judged apart; both get
the smallest id that their text reaches. Null ids: component_id is the smallest id reached that isn't null, null if
there is none. Other columns are ignored. N-grams are compared by 64-bit hashes: of m different ones in all, about
m * m / 2**65 pairs are taken for equal, which only matters within a pair of texts at the border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, join_by_weight, shuffle_partitions, text_hash
from brindle.llm.components import connected_components

N, GROUPS, FANOUT = 5, 256, 16
DF_BITS = 18
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_VALUE = _mix((_LOWER.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
_R = 0xD6E8FEB86659FD93
_R_INV = pow(_R, -1, 1 << 64)
_C = _mix(np.arange(1, N + 1, dtype=np.uint64) * U(0xA0761D6478BD642F)) | U(1)


class _Powers:
    """Powers of a base and of its inverse, modulo 2**64, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            ones = np.ones(size, np.uint64)
            self.up, self.down = ones.copy(), ones.copy()
            self.up[1:], self.down[1:] = U(_R), U(_R_INV)
            self.up, self.down = np.cumprod(self.up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _POWERS.to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0x8EBC6AF09C88C6E3))
    bounds = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    if len(words) >= N:
        m = len(words) - N + 1
        grams = words[:m] * _C[0]
        for k in range(1, N):
            grams += words[k : k + m] * _C[k]
        grams = _mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= N:
            out.append(np.unique(grams[a : b - N + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * _C[: b - a]).sum(dtype=np.uint64, keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _in_parts(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sets of a column of texts, about ``limit`` bytes at a time, with the number of the first."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append((t.as_py() or "").encode())
        size += len(held[-1]) + 1
        if size > limit:
            yield first, shingle_sets(held)
            first, held, size = k + 1, [], 0
    if held:
        yield first, shingle_sets(held)


def _class_of(s: np.ndarray) -> int:
    if not len(s):
        return 0
    one, two = _mix(s + U(0x1234567)).sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(s ^ U(0x5851F42D4C957F2D)))
    return int(_mix(np.array([one], np.uint64) * U(0x9E3779B97F4A7C15) + _mix(np.array([two + U(len(s))], np.uint64)))[0].astype(np.int64))


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << DF_BITS, np.int64)
    for b in batches:
        for _, sets in _in_parts(b.column(0)):
            counts += np.bincount((np.concatenate(sets) & U((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])


def _prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _describe(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls, size, prefix, vec = [], [], [], []
        for _, sets in _in_parts(b.column("text")):
            for s in sets:
                cls.append(_class_of(s))
                size.append(len(s))
                if not len(s):
                    prefix.append(s.astype(np.int64))
                    vec.append(b"")
                    continue
                p = _prefix_size(len(s))
                rank = counts[(s & U((1 << DF_BITS) - 1)).astype(np.int64)]
                prefix.append(s[np.lexsort((s, rank))[:p]].astype(np.int64))
                groups = np.bincount((s >> U(64 - 8)).astype(np.int64), minlength=GROUPS)
                vec.append(groups.astype("u1" if groups.max() < 256 else "<u2" if groups.max() < 65_536 else "<u4").tobytes())
        flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]).astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(cls, pa.int64()), pa.array(size, pa.int64()), lists, pa.array(vec, pa.binary())], names=["doc_id", "th", "cls", "n", "prefix", "vec"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, sets in _in_parts(b.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "items"])


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: "u1", 2: "<u2", 4: "<u4"}[len(raw) // GROUPS]).astype(np.int32)


def _may_link(overlap: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether an overlap (or a bound of it) allows 100 * inter >= 80 * union for sets of these sizes."""
    return 9 * overlap >= 4 * (size_a + size_b)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("aset"), b.column("bset"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            inter = len(s) + len(t) - len(np.union1d(s, t))
            keep.append(100 * inter >= 80 * (len(s) + len(t) - inter) and inter > 0)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def tree_levels(vec: np.ndarray, size: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """The order of the points (component, size) and, from leaves to root, the greatest counts, least and greatest sizes
    and least and greatest components of the nodes: an R-tree packed bottom-up."""
    order = np.lexsort((size, comp))
    levels = [(vec[order], size[order], size[order], comp[order], comp[order])]
    while len(levels[-1][0]) > 1:
        hi, low, high, c0, c1 = levels[-1]
        at = np.arange(0, len(hi), FANOUT)
        levels.append((np.maximum.reduceat(hi, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))
    return order, levels


def tree_query(vec: np.ndarray, size: np.ndarray, point: int) -> np.ndarray:
    """The numbers of the other points that their count vectors allow to link with one point, by descent of the tree."""
    order, levels = tree_levels(vec, size, np.zeros(len(size), np.int64))
    nodes = np.zeros(1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        hi, low, high, _, _ = levels[k]
        nodes = nodes[(5 * high[nodes] >= 4 * size[point]) & (5 * size[point] >= 4 * low[nodes])]
        nodes = nodes[_may_link(np.minimum(hi[nodes], vec[point]).sum(axis=1), low[nodes], size[point])]
        if k:
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
            nodes = nodes[nodes < len(levels[k - 1][0])]
    found = order[nodes]
    return found[found != point]


def tree_pairs(vec: np.ndarray, size: np.ndarray, comp: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs of points (rows of their numbers) of different components that their count vectors allow.

    Two copies of the tree are descended at once. side: if given, only pairs of different sides.
    """
    order, levels = tree_levels(vec, size, comp)
    pairs = np.array([[0, 0]])
    for k in range(len(levels) - 1, -1, -1):
        hi, low, high, c0, c1 = levels[k]
        kept = []
        for part in np.array_split(pairs, max(1, len(pairs) // 20_000)):
            i, j = part[:, 0], part[:, 1]
            one = (c0[i] == c1[i]) & (c0[j] == c1[j]) & (c0[i] == c0[j])
            fits = ~one & (5 * high[i] >= 4 * low[j]) & (5 * high[j] >= 4 * low[i])
            i, j = i[fits], j[fits]
            if len(i):
                fits = _may_link(np.minimum(hi[i], hi[j]).sum(axis=1), low[i], low[j])
                kept.append(np.stack([i[fits], j[fits]], axis=1))
        pairs = np.concatenate(kept) if kept else np.zeros((0, 2), np.int64)
        if k and len(pairs):
            below = len(levels[k - 1][0])
            step = np.arange(FANOUT)
            left = (pairs[:, 0, None, None] * FANOUT + step[:, None] + 0 * step).reshape(-1)
            right = (pairs[:, 1, None, None] * FANOUT + step + 0 * step[:, None]).reshape(-1)
            fine = (left < below) & (right < below) & (left <= right if k > 1 else left < right)
            pairs = np.stack([left[fine], right[fine]], axis=1)
    pairs = order[pairs] if len(pairs) else pairs
    if side is not None and len(pairs):
        pairs = pairs[side[pairs[:, 0]] != side[pairs[:, 1]]]
    return pairs


def likeliest(pairs: np.ndarray, vec: np.ndarray, size: np.ndarray, best: int) -> np.ndarray:
    """Of the pairs those that are among the ``best`` of either point, by overlap bound to sizes."""
    ratio = np.concatenate([np.minimum(vec[p[:, 0]], vec[p[:, 1]]).sum(axis=1) / (size[p[:, 0]] + size[p[:, 1]]) for p in np.array_split(pairs, max(1, len(pairs) // 20_000))])
    point, row = pairs.T.reshape(-1), np.tile(np.arange(len(pairs)), 2)
    order = np.lexsort((-ratio[row], point))
    first = np.concatenate([[0], np.flatnonzero(np.diff(point[order])) + 1])
    rank = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
    return pairs[np.unique(row[order[rank < best]])]


def _search_families(batches: Iterator[pa.RecordBatch], best: int | None, lead_only: bool) -> Iterator[pa.RecordBatch]:
    """Rows (lead, cell, cls, n, comp, side, vec) in order of lead and cell: candidate pairs of each cell.

    best: if given, only that many of each member's candidates, the likeliest. lead_only: only pairs with the lead.
    """

    def search(rows: pa.Table) -> pa.RecordBatch | None:
        cls = rows.column("cls").to_numpy()
        vec = np.stack([_vector(x) for x in rows.column("vec").to_pylist()])
        side = rows.column("side").to_numpy()
        size = rows.column("n").to_numpy()
        if lead_only:
            lead = int(np.flatnonzero(cls == rows.column("lead")[0].as_py())[0])
            found = tree_query(vec, size, lead)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[found], cls[lead])), pa.array(np.maximum(cls[found], cls[lead]))], names=["a", "b"]) if len(found) else None
        pairs = tree_pairs(vec, size, rows.column("comp").to_numpy(), side if side.min() != side.max() else None)
        if not len(pairs):
            return None
        if best is not None:
            pairs = likeliest(pairs, vec, size, best)
        a, b = cls[pairs[:, 0]], cls[pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column("lead").to_numpy(), b.column("cell").to_numpy()])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(x, y - x)
            if held and (held[-1].column("lead")[0] != part.column("lead")[0] or held[-1].column("cell")[0] != part.column("cell")[0]):
                if out := search(pa.Table.from_batches(held)):
                    yield out
                held = []
            held.append(part)
    if held and (out := search(pa.Table.from_batches(held))):
        yield out


class NgramJoin:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 2_048, first_best: int = 4, broadcast_ids: int = 1_000_000):
        self.spark: SparkSession = docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("th"))
        self.scratch = Scratch(self.spark, "ngram-join")
        self.verified: list[DataFrame] = []
        self.block_rows, self.first_best, self.broadcast_ids = block_rows, first_best, broadcast_ids

    def describe(self) -> DataFrame:
        """doc_id, th (text hash), cls, n, prefix, vec of every row."""
        counted = self.docs.select("text").mapInArrow(_count_buckets, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
        counts = np.zeros(1 << DF_BITS, np.int64)
        got = counted.toPandas()  # at most 2**DF_BITS rows
        counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
        shared = self.spark.sparkContext.broadcast(counts)
        out = self.docs.mapInArrow(lambda b: _describe(b, shared.value), "doc_id bigint, th bigint, cls bigint, n bigint, prefix array<bigint>, vec binary")
        return self.scratch.write(out, "described")

    def verify(self, pairs: DataFrame, places: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b) of classes, a < b, not verified before, those that link. places: cls and at (its smallest doc_id, th)."""
        pairs = pairs.distinct()
        for before in self.verified:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = self.scratch.write(pairs, "pairs")
        self.verified.append(pairs)
        wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        ids = places.join(wanted, "cls", "left_semi")
        ids = self.scratch.write(ids.select("cls", F.col("at.doc_id").alias("_did"), F.col("at.th").alias("_th")), "wanted")
        few = ids.count() <= self.broadcast_ids
        some = ids.select("_did", "_th").distinct()
        texts = self.docs.join(F.broadcast(some) if few else some, F.col("doc_id").eqNullSafe(F.col("_did")) & (F.col("th") == F.col("_th")), "left_semi").select("text")
        sets = texts.mapInArrow(_sets, "cls bigint, items binary").join(F.broadcast(wanted) if few else wanted, "cls", "left_semi").dropDuplicates(["cls"])
        sets = self.scratch.write(sets, "sets")
        named = lambda k: sets.select(F.col("cls").alias(k), F.col("items").alias(f"{k}set"))
        out = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "aset", "bset").mapInArrow(_verified, "a bigint, b bigint")
        out = self.scratch.write(out, "links")
        self.scratch.drop(sets, ids)
        return out

    def families(self, classes: DataFrame) -> DataFrame:
        """lead, cls, n: the distinct members of all blocks with the smallest member lead."""
        keyed = classes.select(F.explode("prefix").alias("block"), "cls", "n")
        blocks = self.scratch.write(keyed.groupBy("block").agg(F.count("*").alias("c"), F.min("cls").alias("lead")).filter("c > 1"), "blocks")
        out = self.scratch.write(join_by_weight(keyed, blocks, "block", "c").select("lead", "cls", "n").distinct(), "families")
        self.scratch.drop(blocks)
        return out

    def candidates(self, families: DataFrame, points: DataFrame, comps: DataFrame | None = None, best: int | None = None) -> DataFrame:
        """Pairs (a, b) that the families' R-trees find: of each lead and its members, or, with the components found so
        far, of members of different components."""
        rest, lead_only = families, comps is None
        if lead_only:
            rest = rest.withColumn("comp", F.col("cls"))
        else:
            rest = rest.join(comps, F.col("cls") == F.col("node"), "left").select("lead", "cls", "n", F.coalesce("comp", "cls").alias("comp"))
        mixed = rest.groupBy("lead").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("w")).filter("c0 != c1")
        mixed = self.scratch.write(mixed.select("lead", "w", F.ceil(F.col("w") / self.block_rows).cast("int").alias("k")), "mixed")
        rest = join_by_weight(rest, mixed, "lead", "w").join(points.select("cls", "vec"), "cls")
        # A small family is one cell. A large one is asked for its lead chunk by chunk; else each pair of its chunks is a cell.
        every = F.sequence(F.lit(0), F.col("k") - 1)
        rest = rest.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
        rest = rest.withColumn("other", F.explode(F.when(F.col("cls") == F.col("lead"), every).otherwise(F.array("chunk")) if lead_only else every))
        cell = F.col("other") if lead_only else (F.least("chunk", "other") * F.col("k") + F.greatest("chunk", "other")).cast("int")
        cells = rest.select("lead", cell.alias("cell"), "cls", "n", "comp", F.when(F.col("k") == 1, 0).otherwise(F.col("chunk")).alias("side"), "vec")
        cells = cells.repartition(shuffle_partitions(self.spark), "lead", "cell").sortWithinPartitions("lead", "cell")
        return cells.mapInArrow(lambda b: _search_families(b, best, lead_only), "a bigint, b bigint")

    def run(self) -> DataFrame:
        """doc_id, th (text hash), cls, n_shingles, component_id, comp (a class that names the component) of every row."""
        described = self.describe()
        each = self.scratch.write(described.select("doc_id", "th", "cls", "n"), "each")
        classes = self.scratch.write(described.filter("n > 0").select("cls", "n", "prefix", "vec").dropDuplicates(["cls"]), "classes")
        self.scratch.drop(described)
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
        places = self.scratch.write(each.groupBy("cls").agg(least.alias("at"), F.count("*").alias("w")), "places")
        points = classes.select("cls", "n", "vec")
        families = self.families(classes)

        links = self.verify(self.candidates(families, points), places)
        comps = connected_components(links, self.scratch)
        for best in (self.first_best, None):
            links = links.unionByName(self.verify(self.candidates(families, points, comps, best), places))
            before, comps = comps, connected_components(links, self.scratch)
            self.scratch.drop(before)
        self.scratch.drop(classes, families, *self.verified)
        low = places.select("cls", F.col("at.doc_id").alias("low"), "w")
        low = low.join(comps, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "low", "w")
        root = low.groupBy("comp").agg(F.min("low").alias("component_id"))
        by_class = self.scratch.write(low.join(root, "comp").select("cls", "component_id", "comp", "w"), "by-class")
        out = join_by_weight(each.select("doc_id", "th", "cls", F.col("n").alias("n_shingles")), by_class, "cls", "w")
        return out.select("doc_id", "th", "cls", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "comp")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(spark.read.parquet(f"{sf_dir}/documents.parquet")).run().select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by 1) c using (doc_id)
"""
