"""Approximate nearest neighbours (largest cosine) by robust-pruned directed graphs, one per shard.

Every distinct usable direction goes, by hash, to one of the shards of about ``shard_rows`` of them. A shard's graph starts
as random edges; then, in batches, greedy searches from starts spread over the shard propose neighbours for each vector,
and relaxed-distance pruning keeps those that no kept neighbour is ``alpha`` times nearer to, at most ``degree`` of them;
back edges are added and pruned in the same way. ``far`` random edges of each vector are never pruned, so a clump of near
copies, whose nearest neighbours are all its own, stays no dead end; what no start reaches after that is linked from a
random vector that one does. The index is a table of one row per shard: vectors, ids and edges.

A query searches the graph of every shard with a beam of ``beam`` vectors, all of which are scored again on the original
vectors in double precision; where fewer than k come out although the shard holds more, the whole shard is scored. Queries
reach a shard in chunks of about ``chunk_rows``, so neither side of a task grows with the data; each query costs one beam
search a shard.

Vectors of one direction (unit vectors equal to nine decimals) have one cosine with any query, so they are one point, with
their k + 1 smallest ids: no other id of theirs can be among a query's k nearest, as ties go to smaller ids. Their score is
that of the vector with the smallest id. So a third of all rows may be equal, or multiples of each other, in one point.

Defined cases: vectors that are null, empty, all zero, hold nulls or values that aren't finite, or have another
dimension than the query set's most frequent one, take no part, as queries or candidates; so do rows with a null id.
Rows with an equal id and vector are one candidate, and one query. Rows with an equal id and different vectors are
candidates each, and queries with a result each; no row is a candidate of a query of its own id. Ids may be negative.
Fewer than k candidates: all of them. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, let


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by a power of two, so that their squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and cosines of the nearest found, nearest first, for each row of q; x and q are unit vectors."""
    n = len(x)
    ids = np.full((len(q), beam), -1, np.int64)
    sims = np.full((len(q), beam), -np.inf, np.float32)
    open_ = np.zeros((len(q), beam), bool)
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    starts = np.atleast_1d(starts)[:beam]
    m = len(starts)
    ids[:, :m], sims[:, :m], open_[:, :m], seen[:, starts] = starts, q @ x[starts].T, True, True
    padded = np.concatenate([graph, np.full((1, graph.shape[1]), n)])
    padded[padded < 0] = n
    live = np.arange(len(q))
    while len(live):
        best = np.argsort(np.where(open_[live], -sims[live], np.inf), axis=1, kind="stable")[:, :wide]
        r = live[:, None]
        chosen = np.where(open_[r, best], ids[r, best], n)
        open_[r, best] = False
        near = padded[chosen].reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[r, near]] = n
        seen[r, near] = True
        new = np.einsum("bkd,bd->bk", x[np.minimum(near, n - 1)], q[live])
        new[near == n] = -np.inf
        all_ids = np.concatenate([ids[live], np.where(near == n, -1, near)], axis=1)
        all_sims = np.concatenate([sims[live], new], axis=1)
        all_open = np.concatenate([open_[live], near < n], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        rows = np.arange(len(live))[:, None]
        ids[live], sims[live], open_[live] = all_ids[rows, order], all_sims[rows, order], all_open[rows, order]
        live = live[open_[live].any(axis=1)]
    return ids, sims


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point the neighbours kept of its candidates (-1: none): the nearest left is kept, and those that it is
    alpha times nearer to than the point is are dropped."""
    c = np.sort(candidates, axis=1)
    bad = (c < 0) | (c == points[:, None])
    bad[:, 1:] |= c[:, 1:] == c[:, :-1]
    v = x[np.maximum(c, 0)]
    dist = 2 - 2 * np.einsum("bkd,bd->bk", v, x[points])
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    dist[bad] = np.inf
    out, rows = np.full((len(points), degree), -1, np.int64), np.arange(len(points))
    for k in range(degree):
        best = dist.argmin(axis=1)
        found = np.isfinite(dist[rows, best])
        if not found.any():
            break
        out[found, k] = c[rows, best][found]
        dist[alpha * between[rows, best] <= dist] = np.inf
        dist[rows, best] = np.inf
    return out


def spread(x: np.ndarray, many: int, rng: np.random.Generator, of: int = 1_024) -> np.ndarray:
    """Starts: of a random part of the vectors the middle one, then always the one farthest from all before."""
    some = rng.permutation(len(x))[:of]
    v = x[some]
    chosen = [int((v @ v.mean(axis=0)).argmax())]
    near = v @ v[chosen[0]]
    while len(chosen) < min(many, len(some)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    return np.unique(some[chosen])


def linked(graph: np.ndarray, starts: np.ndarray, rng: np.random.Generator) -> None:
    """Gives each vector that no start reaches an edge from a random one that is reached, in place of its last."""
    reached = np.zeros(len(graph) + 1, bool)
    todo = starts
    while True:
        while len(todo):
            reached[todo] = True
            todo = np.unique(graph[todo])
            todo = todo[(todo >= 0) & ~reached[todo]]
        lost = np.flatnonzero(~reached[:-1])
        if not len(lost):
            return
        have = np.flatnonzero(reached[:-1])
        lost = lost[: len(have)]
        graph[rng.permutation(have)[: len(lost)], -1] = lost
        # An edge that was replaced may have been the only one to another vector.
        reached[:] = False
        todo = starts


def build_graph(x: np.ndarray, degree: int = 28, beam: int = 56, alpha: float = 1.2, batch: int = 256, seed: int = 0, far: int = 4, many_starts: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rows of neighbour numbers, -1: none; the last ``far`` are random) and the starts of searches."""
    n, rng = len(x), np.random.default_rng(seed)
    starts = spread(x, many_starts, rng)
    graph = rng.integers(0, n, (n, degree + far))
    near = graph[:, :degree]  # a view
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            p = order[k : k + batch]
            found, _ = beam_search(x, graph, starts, x[p], beam)
            near[p] = robust_prune(x, p, np.concatenate([found, near[p]], axis=1), degree, a)
            src, dst = np.repeat(p, degree), near[p].reshape(-1)
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            to, first, times = np.unique(dst, return_index=True, return_counts=True)
            width = int(times.max()) if len(times) else 0
            back = np.full((len(to), width), -1, np.int64)
            back[np.repeat(np.arange(len(to)), times), np.arange(len(dst)) - np.repeat(first, times)] = src
            # Free places take back edges as they come; where they don't suffice, all are pruned together.
            have = (near[to] >= 0).sum(axis=1)
            fits = have + times <= degree
            for t, b, m in zip(to[fits], back[fits], times[fits], strict=True):
                kept = near[t][near[t] >= 0]
                new = np.setdiff1d(b[:m], kept)
                near[t, : len(kept)], near[t, len(kept) : len(kept) + len(new)] = kept, new
                near[t, len(kept) + len(new) :] = -1
            full = to[~fits]
            for j in range(0, len(full), batch):
                near[full[j : j + batch]] = robust_prune(x, full[j : j + batch], np.concatenate([near[full[j : j + batch]], back[~fits][j : j + batch]], axis=1), degree, a)
    linked(graph, starts, rng)
    return graph, starts


class VectorIndex:
    """An index table in the shared folder."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, shard_rows: int = 4_096, seed: int = 0):
        self.spark: SparkSession = vectors.sparkSession
        self.scratch, self.k, self.seed = Scratch(self.spark, "vector-index"), k, seed
        v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        v = v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(usable)
        dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        self.dim = dims[0].d if dims else 0
        v = v.filter(F.size("v") == self.dim).dropDuplicates(["id", "v"]) if dims else v
        self.rows = self.scratch.write(v, "rows")
        # Scaled by the largest component first, so that no square overflows or vanishes; -0.0 becomes 0.0.
        ratio = let(F.array_max(F.transform("v", F.abs)), lambda most: F.transform("v", lambda x: x / most))
        direction = let(ratio, lambda u: let(F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(u, lambda x: F.round(x / norm, 9) + 0.0)))
        one = self.rows.select("id", "v", F.xxhash64(direction).alias("h"))
        part = F.pmod(F.xxhash64("id"), F.lit(64))
        # The smallest ids of parts of a direction, then of all of it: a third of all rows in one sorts in 64 tasks.
        for by in (["h", part], ["h"]):
            one = one.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id", "v"))).filter(F.col("r") <= k + 1).drop("r")
        self.points = one.groupBy("h").agg(F.min_by("v", F.struct("id", "v")).alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
        self.points = self.scratch.write(self.points, "points")
        self.shards = max(1, -(-self.points.count() // shard_rows))
        sharded = self.points.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(self.shards)).cast("int"))

        def build(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("h", kind="stable")
            x = scaled(np.stack(g["v"].to_list()).astype(np.float64))
            graph, starts = build_graph(unit(x), seed=seed)
            ids, held = np.zeros((len(g), k + 1), np.int64), g["ids"].map(len).to_numpy()
            ids[np.arange(k + 1) < held[:, None]] = np.concatenate(g["ids"].to_list())
            return pd.DataFrame({"shard": [g["shard"].iloc[0]], "starts": [starts.tolist()], "x": [x.tobytes()], "ids": [ids.tobytes()], "held": [held.astype(np.int64).tobytes()], "graph": [graph.astype(np.int32).tobytes()]})

        built = sharded.select("shard", "h", "v", "ids").groupBy("shard").applyInPandas(build, "shard int, starts array<bigint>, x binary, ids binary, held binary, graph binary")
        self.index = self.scratch.write(built, "index")

    def search(self, queries: DataFrame, beam: int = 96, chunk_rows: int = 4_096) -> DataFrame:
        """query_id, rank (from 1), vec_id, score of the k nearest of each query vector. queries: id and v, usable vectors of
        this dimension."""
        k, dim, shards = self.k, self.dim, self.shards
        chunks = max(1, -(-queries.count() // chunk_rows))
        q = queries.select(F.col("id").alias("qid"), F.xxhash64("v").alias("qh"), F.col("v").alias("qv")).withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int"))
        q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        index = self.index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def run(ask: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
            out = {"query_id": [], "qh": [], "vec_id": [], "score": []}
            if len(ask) and len(shard):
                s = shard.iloc[0]
                x = np.frombuffer(s["x"]).reshape(-1, dim)
                ids, graph = np.frombuffer(s["ids"], np.int64).reshape(len(x), k + 1), np.frombuffer(s["graph"], np.int32).reshape(len(x), -1).astype(np.int64)
                filled = np.arange(k + 1) < np.frombuffer(s["held"], np.int64)[:, None]
                near, norm = unit(x), np.linalg.norm(x, axis=1)

                def ranked(found: np.ndarray, qv: np.ndarray, qid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    """Ids and exact scores of all members of the points found, and the places of the k best."""
                    at = np.maximum(found, 0)
                    score = np.einsum("bkd,bd->bk", x[at], qv) / (norm[at] * np.linalg.norm(qv, axis=1)[:, None])
                    score = np.where(found < 0, -np.inf, score)
                    every, scores = ids[at].reshape(len(qv), -1), np.repeat(score, k + 1, axis=1)
                    scores = np.where(~filled[at].reshape(len(qv), -1) | (every == qid[:, None]), -np.inf, scores)
                    return every, scores, np.lexsort((every, -scores), axis=1)[:, :k]

                for b in range(0, len(ask), 256):
                    some = ask.iloc[b : b + 256]
                    qv, qid = scaled(np.stack(some["qv"].to_list()).astype(np.float64)), some["qid"].to_numpy()
                    found, _ = beam_search(near, graph, np.asarray(s["starts"]), unit(qv), beam)
                    every, scores, order = ranked(found, qv, qid)
                    rows = np.arange(len(some))[:, None]
                    good = np.isfinite(scores[rows, order])
                    few = np.flatnonzero(good.sum(axis=1) < k) if len(x) > beam else []
                    if len(few):  # every point of the shard, some queries at once
                        for j in range(0, len(few), 8):
                            f = few[j : j + 8]
                            e, c, o = ranked(np.broadcast_to(np.arange(len(x)), (len(f), len(x))), qv[f], qid[f])
                            r = np.arange(len(f))[:, None]
                            every[f, :k], scores[f, :k], order[f] = e[r, o], c[r, o], np.arange(k)
                        good = np.isfinite(scores[rows, order])
                    out["query_id"].append(np.broadcast_to(qid[:, None], order.shape)[good])
                    out["qh"].append(np.broadcast_to(some["qh"].to_numpy()[:, None], order.shape)[good])
                    out["vec_id"].append(every[rows, order][good])
                    out["score"].append(scores[rows, order][good])
            return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, t) for (c, x), t in zip(out.items(), (np.int64, np.int64, np.int64, np.float64), strict=True)})

        got = q.groupBy("shard", "chunk").cogroup(index.groupBy("shard", "chunk")).applyInPandas(run, "query_id bigint, qh bigint, vec_id bigint, score double")
        best = F.row_number().over(Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id"))
        return got.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = VectorIndex(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return index.search(index.rows.filter(F.col("id") % 50 == 0))
