"""Near vectors, interval joins, sketches, learned classes and bucketed joins against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import intervals as I
from brindle.operators import nested_writes as W
from brindle.operators import similarity as N
from brindle.operators import sketches as K
from brindle.operators import words as B
from brindle.operators.bucketed import bucketed
from brindle.operators.extensions import Client, Extension
from brindle.operators.intervals import overlap_counts, overlaps
from brindle.operators.ranks import values_at
from brindle.plans import cluster_queries, scale_queries
from tests.compare import assert_same

VECTORS = "id bigint, v array<float>"


def _clumps(seed: int, n: int = 300, dims: int = 16) -> list[tuple]:
    """Clumps of near vectors, multiples of one vector, and rows that take no part."""
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((12, dims))
    v = [centres[rnd.integers(12)] + 0.25 * rnd.standard_normal(dims) if k % 3 else rnd.standard_normal(dims) for k in range(n)]
    v += [centres[0] * (k + 1) for k in range(60)]
    rows = [(k * 7 % 1009, x.tolist()) for k, x in enumerate(v)]
    return rows + [(2000, None), (2001, [0.0] * dims), (2002, [float("nan")] * dims), (2003, [None] + [1.0] * (dims - 1))]


def _cosines(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = [i for i, _ in good], np.array([v / np.linalg.norm(v) for _, v in good])
    return ids, x @ x.T


def _roots(rows, least):
    ids, c = _cosines(rows)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(c >= least, 1)), strict=True):
        x, y = find(ids[a]), find(ids[b])
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_bands_keep_the_recall_asked_for(spark):
    rows = _clumps(1)
    ids, c = _cosines(rows)
    exact = {(ids[a], ids[b]) for a, b in zip(*np.nonzero(c >= 0.8), strict=True) if a != b}
    df = spark.createDataFrame(rows, VECTORS)
    for recall in (0.9, 0.999):
        found = [(r.new_id, r.old_id) for r in N.near_pairs(df, df, "id", "v", 0.8, recall=recall).collect()]
        assert len(found) == len(set(found)) and set(found) <= exact
        assert len(found) >= (recall - 0.02) * len(exact)
    bits, tables = N.bands(10**9, 0.9)
    p = 1 - math.acos(0.9) / math.pi
    assert bits == 24 and (1 - p**bits) ** tables <= 0.001


def test_near_pairs_in_a_window(spark):
    rows = _clumps(2)
    df = spark.createDataFrame(rows, VECTORS).withColumn("at", F.timestamp_seconds(F.col("id") * 60)).withColumn("b", F.col("id") % 2)
    ids, c = _cosines(rows)
    exact = {(x, y) for a, x in enumerate(ids) for b, y in enumerate(ids) if x != y and c[a, b] >= 0.8 and 0 <= (x - y) * 60 <= 3_600 and x % 2 == y % 2}
    pairs = N.near_pairs(df, df, "id", "v", 0.8, block="b", at="at", window_s=3_600)
    assert {(r.new_id, r.old_id) for r in pairs.collect()} == exact
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("cell", [7, 2_048])
def test_clusters_are_components(spark, cell):
    rows = _clumps(3)
    df = spark.createDataFrame(rows, VECTORS)
    found = N.components(N.links(df, "id", "v", 0.8, cell=cell))
    got = {i: i for i, _ in rows} | {r.id: r.root for r in found.collect()}
    assert got == _roots(rows, 0.8)
    if cell > 7:
        assert {r.id: r.cluster for r in N.clusters(df, "id", "v", 0.8).collect()} == got


def test_components_of_a_path(spark):
    ids = list(range(0, 400))
    random.Random(4).shuffle(ids)
    edges = list(zip(ids[:-1], ids[1:], strict=True)) + [(1000, 1001), (1001, 1001)]
    got = {r.id: r.root for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(400)} | {1000: 1000, 1001: 1000}
    assert N.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_rounds_equal_one_batch(spark):
    rows = _clumps(5)
    df = spark.createDataFrame(rows, VECTORS)
    known, seen = spark.createDataFrame([], f"{VECTORS}, cluster bigint"), []
    for k in range(3):
        part = [r for r in rows if r[0] % 3 == k]
        known, seen = N.grown(known, spark.createDataFrame(part, VECTORS), "id", "v", 0.8), seen + part
        assert {r.id: r.cluster for r in known.collect()} == _roots(seen, 0.8)
    stopped = N.rounds(df.withColumn("r", F.col("id") % 3), "r", "id", "v", 0.8, clusters_wanted=2, size=4).collect()
    first = next(k for k in range(3) if sum(n >= 4 for n in Counter(_roots([r for r in rows if r[0] % 3 <= k], 0.8).values()).values()) >= 2)
    assert {r.stopped_in for r in stopped} == {first} and {r.id for r in stopped} == {i for i, _ in rows if i % 3 <= first}


def test_overlaps_against_all_pairs(spark):
    rnd = random.Random(6)

    def some(n):
        out = []
        for k in range(n):
            begin = rnd.randrange(-5_000, 5_000)
            out.append((k, rnd.choice([None, begin, begin, begin, begin]), rnd.choice([None, begin, begin + rnd.randrange(10), begin + int(2 ** rnd.uniform(0, 13)), begin - 1]), rnd.choice(["x", "y", None])))
        return out

    a, b = some(150), some(170)
    low, high = (lambda x: -math.inf if x is None else x), (lambda x: math.inf if x is None else x)

    def meet(p, q):
        return low(p[1]) <= high(p[2]) and low(q[1]) <= high(q[2]) and max(low(p[1]), low(q[1])) <= min(high(p[2]), high(q[2]))

    schema = "id int, begin bigint, end bigint, k string"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = overlaps(da, db, ("begin", "end"), ("begin", "end"))
    assert Counter((r.left.id, r.right.id) for r in got.collect()) == Counter((p[0], q[0]) for p in a for q in b if meet(p, q))
    got = overlaps(da, db, ("begin", "end"), ("begin", "end"), on=("k",))
    assert Counter((r.left.id, r.right.id) for r in got.collect()) == Counter((p[0], q[0]) for p in a for q in b if meet(p, q) and p[3] == q[3] is not None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert overlaps(da.limit(0), db, ("begin", "end"), ("begin", "end")).collect() == []


def test_sketches_are_near_and_merge(spark):
    rows = spark.range(200_000).select((F.col("id") % 20).alias("day"), (F.col("id") % 2).alias("k"), (F.col("id") % 70_000).alias("user"), (F.sqrt("id")).alias("x"))
    days = K.kept(rows, ["day", "k"], "user", "x")
    assert days.count() == 20
    for keys in (["k"], []):
        got = {r.k if keys else None: r for r in K.merged(days, keys).select(*keys, K.distinct_estimate().alias("users"), K.quantile(0.5).alias("m"), "n").collect()}
        for r in rows.groupBy(*keys).agg(F.countDistinct("user").alias("users"), F.percentile("x", F.lit(0.5)).alias("m"), F.count("*").alias("n")).collect():
            x = got[r.k if keys else None]
            assert x.n == r.n and abs(x.users - r.users) <= 0.06 * r.users and abs(x.m - r.m) <= 0.02 * r.m
    a, b = (K.merged(days.filter(f"k = {k}").drop("k"), []).select(F.col("distinct_theta").alias(f"t{k}")) for k in (0, 1))
    assert a.crossJoin(b).select(K.common_estimate("t0", "t1").alias("n")).first().n == 0


def test_naive_bayes_by_hand(spark):
    rows = [(1, "good good fine", "p"), (2, "bad awful", "n"), (3, "bad", "n"), (4, "good", None), (5, None, None), (6, "unseen bad", None)]
    df = spark.createDataFrame(rows, "id int, t string, y string")
    n, prior = B.naive_bayes(df, "y", "t")
    counts, total, size = {("p", "good"): 2, ("p", "fine"): 1, ("n", "bad"): 2, ("n", "awful"): 1}, {"p": 3, "n": 3}, 4
    assert {(r.label, r.word): r.n for r in n.collect()} == counts
    got = {r.id: r for r in B.classify(df, ["id"], "t", (n, prior)).collect()}
    for i, t, _ in rows:
        w = (t or "").split()
        s = {y: math.log({"p": 1, "n": 2}[y] / 3) + sum(math.log((counts.get((y, x), 0) + 1) / (total[y] + size)) for x in w) for y in "np"}
        assert got[i].label == max("np", key=lambda y: s[y]) and got[i].score == pytest.approx(max(s.values()), abs=1e-5)


def test_keyness(spark):
    rows = [(1, "a b c c c c"), (1, "c d"), (2, "a b b b b"), (3, "a d d d e e e"), (None, "c c c c")]
    got = B.keyness(spark.createDataFrame(rows, "g int, t string"), "g", "t", top=1, least=2).collect()
    assert {(r.g, r.word, r.a, r.b) for r in got} == {(1, "c", 5, 0), (2, "b", 4, 1), (3, "d", 3, 1)} or {(r.g, r.word) for r in got} == {(1, "c"), (2, "b"), (3, "e")}
    assert {r.g: r.g2 for r in got}[1] == pytest.approx(2 * 5 * math.log(5 / (8 * 5 / 20)), abs=1e-5)


def test_bucketed_tables_join_without_exchange(spark):
    left, right = (spark.range(5_000).select((F.col("id") % m).alias(k), "id") for m, k in ((700, "a"), (900, "b")))
    a, b = bucketed(left, "a", 4), bucketed(right, "b", 4)
    joined = a.hint("merge").join(b, F.col("a") == F.col("b")).groupBy("a").agg(F.count("*").alias("n"))
    assert joined.count() == 700
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_naive_bayes_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held", F.col("doc_id") % 4 == 2)
    got = B.classify(docs.filter("held"), ["doc_id"], "text", B.naive_bayes(docs.filter("not held"), "lang", "text")).join(docs, "doc_id")
    assert got.filter("label = lang").count() >= 0.95 * got.count() > 0


def test_extensions_stack(spark):
    rows = spark.createDataFrame([(1, 5), (2, 7), (3, None)], "id int, v int")
    c = Client({"t": rows}, {"t": ["id"]})
    more = c.extend(Extension(fields={"t": {"w": F.col("v") + 1}}), Extension(fields={"t": {"x": F.col("w") * 2}}))
    assert [tuple(r) for r in more.find_many("t", order_by=["id"]).collect()] == [(1, 5, 6, 12), (2, 7, 8, 16), (3, None, None, None)]
    assert c.find_many("t").columns == ["id", "v"]
    seen = []

    def hook(name):
        def run(table, args, on):
            seen.append(name)
            return on(args | {"take": 1})

        return run

    hooked = more.extend(Extension(hooks={"t": hook("inner")}), Extension(hooks={"*": hook("outer")}))
    assert [r.id for r in hooked.find_many("t", order_by=[("id", "desc")], filter={"x": {"gt": 1}}).collect()] == [2] and seen == ["outer", "inner"]
    own = more.extend(Extension(operations={"*": {"f": lambda rows, k: k}}), Extension(operations={"t": {"f": lambda rows, k: rows.count() + k}}))
    assert own.call("t", "f", 4) == 7
    with pytest.raises(AttributeError):
        c.call("t", "f")


def test_nested_writes_by_hand(spark):
    children = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, None, "c")], "k int, fk int, v string")
    wanted = spark.createDataFrame([(1, 30, "x", 1), (2, 20, "y", 2), (4, 40, "z", 4), (4, 50, "late", 5), (None, 60, "n", 6)], "k int, fk int, v string, pos int")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(W.connect_or_create(children, wanted, "k", "fk", "pos").rows) == sorted([(1, 30, "a"), (2, 20, "b"), (3, None, "c"), (4, 40, "z"), (None, 60, "n")], key=str)
    done = W.upsert(children, wanted, "k", "fk", {"v": F.concat("v", "_w_v")}, "pos")
    assert rows(done.rows) == sorted([(1, 10, "a"), (2, 20, "by"), (3, None, "c"), (4, 40, "z"), (None, 60, "n")], key=str)
    assert rows(done.changed) == sorted([(2, 20, "by"), (4, 40, "z"), (None, 60, "n")], key=str)
    parents = spark.createDataFrame([(20, "p"), (40, "q")], "id int, name string")
    assert rows(W.create_many(children, wanted, "k", "fk", parents, "id", "pos", skip_duplicates=True).changed) == [(4, 40, "z")]
    asked = spark.createDataFrame([(1, 70, "new"), (2, 70, "newer"), (3, 40, "q2"), (9, 80, "nobody")], "_child int, id int, name string")
    kids, all_parents = W.connect_or_create_parent(children, "k", "fk", parents, "id", asked)
    assert rows(kids) == [(1, 70, "a"), (2, 70, "b"), (3, 40, "c")] and rows(all_parents) == [(20, "p"), (40, "q"), (70, "new")]
    kids, all_parents = W.upsert_parent(children, "fk", parents, "id", {"name": F.upper("name")}, {"id": -F.col("k"), "name": F.col("v")})
    assert rows(kids) == sorted([(1, 10, "a"), (2, 20, "b"), (3, -3, "c")], key=str) and rows(all_parents) == sorted([(20, "P"), (40, "q"), (-3, "c")], key=str)


def test_all_pairs_and_links_at_a_low_cosine(spark):
    """No pair is missed, by cosine or by product, whatever the size of cells; of many rows, after pivots."""
    rnd = np.random.default_rng(11)
    rows = [(k * 3, (x * rnd.uniform(0.5, 2)).tolist()) for k, x in enumerate(rnd.standard_normal((1_500, 24)) / 5)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("b", F.col("id") % 2)
    x = np.array([v for _, v in rows], np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for cosines, s in ((True, unit @ unit.T), (False, x @ x.T)):
        exact = {(3 * a, 3 * b) for a, b in zip(*np.nonzero(s >= 0.45), strict=True) if a != b and a % 2 == b % 2}
        got = [(r.new_id, r.old_id) for r in N.near_pairs(df, df, "id", "v", 0.45, block="b", cosines=cosines).collect()]
        assert len(got) == len(set(got)) and set(got) == exact and exact
    for least, pivots in ((0.45, 400), (0.62, 40), (0.62, 400)):
        found = N.components(N.links(df, "id", "v", least, pivots=pivots, cell=500))
        assert {i: i for i, _ in rows} | {r.id: r.root for r in found.collect()} == _roots(rows, least)


def test_copies_make_no_pairs_of_links(spark):
    """A clump of copies is one cell's matrix, and gives a link a row."""
    df = spark.range(5_000).select("id", F.array(F.lit(1.0), F.col("id") * 0 + 2.0).cast("array<float>").alias("v"))
    found = N.links(df, "id", "v", 0.4)
    assert found.count() < 5_000 * 8 and N.components(found).filter("root = 0").count() == 5_000


@pytest.mark.parametrize("pivots", [20, 1_000])
def test_of_equal_vectors_one_is_compared(spark, monkeypatch, pivots):
    """Clusters of copies, none of them most rows: what is compared grows with the vectors, not with their copies."""
    rnd, compared = np.random.default_rng(13), []
    some = [x.tolist() for x in rnd.standard_normal((60, 24))] + [[0.0] * 23 + [1.0], [-0.0] * 23 + [1.0]]
    rows = [(k, some[k % 62]) for k in range(62 * 30)]
    for name, at in (("_meet", (0,)), ("_across", (0, 1))):
        was = getattr(N, name)
        monkeypatch.setattr(N, name, lambda *a, was=was, at=at: (compared.extend(a[i].count() for i in at), was(*a))[1])
    df = spark.createDataFrame(rows, VECTORS)
    found = N.components(N.links(df, "id", "v", 0.45, pivots=pivots))
    assert {i: i for i, _ in rows} | {r.id: r.root for r in found.collect()} == _roots(rows, 0.45)
    assert compared and max(compared) <= 61
    assert N.links(df, "id", "v", 1.5).collect() == []


def test_equal_vectors_without_a_fresh_row_stay_apart(spark):
    rows = [(1, [1.0, 0.0], False, 1), (2, [1.0, 0.0], False, 2), (3, [0.0, 1.0], False, 3), (4, [0.0, 1.0], True, 4), (5, [0.0, 2.0], False, 5), (6, [-1.0, 0.0], True, 6)]
    df = spark.createDataFrame(rows, f"{VECTORS}, fresh boolean, root bigint")
    roots = lambda df: {r.id: r.root for r in N.components(N.links(df, "id", "v", 0.9, F.col("fresh"), root=F.col("root"))).filter("id <> root").collect()}
    assert roots(df) == {4: 3, 5: 3}
    assert roots(df.union(spark.createDataFrame([(9, [2.0, 0.0], True, 9)], df.schema))) == {4: 3, 5: 3, 2: 1, 9: 1}


def test_texts_are_not_shuffled_by_cluster(spark, sf_dir):
    """One cluster may have nearly all texts, which would then be one task's."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cluster_queries.signals_of(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(cluster" not in plan


def test_open_ends_leave_no_bin_of_everything(spark):
    points = spark.range(2_000).select(F.col("id"), (F.col("id") * 500).alias("at"))
    some = spark.range(900).select("id", F.lit(None).cast("bigint").alias("begin"), (F.col("id") * 3).alias("end"))
    hull = I._hull((points, ("at", "at")), (some, ("begin", "end")))
    a, b = I._side(points, "at", "at", [], "left", hull), I._side(some, "begin", "end", [], "right", hull)
    met = [I._binned(x, n, I._levels(y, o)).groupBy("level", "bin").agg(F.count("*").alias(n)) for x, n, y, o in ((a, "left", b, "right"), (b, "right", a, "left"))]
    assert met[0].join(met[1].toDF("level", "bin", "right"), ["level", "bin"]).agg(F.sum(F.col("left") * F.col("right"))).first()[0] < 2_000 * 900 / 50
    got = Counter((r.left.id, r.right.id) for r in overlaps(points, some, ("at", "at"), ("begin", "end")).collect())
    assert got == Counter((p, k) for p in range(2_000) for k in range(900) if p * 500 <= k * 3)


def test_overlap_counts_against_pairs(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(300):
        begin = rnd.randrange(500)
        rows.append((rnd.choice([k, k, k % 40]), rnd.choice([None, begin, begin]), rnd.choice([None, begin, begin + rnd.randrange(60), begin - 1]), rnd.choice(["x", "y", None])))
    rows += [(None, 1, 2, "x"), (5_000, 10**6, 10**6, "z")]
    df = spark.createDataFrame(rows, "k bigint, begin bigint, end bigint, brand string")
    pairs = overlaps(df, df, ("begin", "end"), ("begin", "end"), on=("brand",)).filter("left.k <> right.k").groupBy("left.k").count()
    assert {tuple(r) for r in overlap_counts(df, "k", ("begin", "end"), "brand").collect()} == {tuple(r) for r in pairs.collect()}


def test_values_at_ranks(spark):
    rows = [("a", float(x)) for x in (5, 1, 1, 3)] + [(None, 2.0), (None, float("nan")), (None, -1.0), ("b", None), ("c", 7.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: (r.n, r.found) for r in values_at(df, ["k"], "x", lambda n: F.array(F.lit(1), F.ceil(n / 2))).collect()}
    assert got == {"a": (4, [1.0, 1.0]), None: (3, [-1.0, 2.0]), "c": (1, [7.0, 7.0])}
    big = spark.range(50_000).select(F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(900)).alias("x"), F.lit(3).alias("times"))
    one = values_at(big, ["k"], "x", lambda n: F.array(F.ceil(n / 2)), "times").first()
    assert one.n == 150_000 and one.found == [sorted(r.x for r in big.collect())[24_999]]


@pytest.mark.parametrize("name", ["A17_daily_sketches", "A17_common_users"])
def test_daily_figures_are_exact(spark, tmp_path, name):
    """More users and values than a sketch keeps whole."""
    rows = spark.range(60_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 40).cast("timestamp_ntz").alias("ts"), F.pmod(F.xxhash64("id"), F.lit(17_000)).alias("user_id"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("event_type"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) / 100).alias("value"), F.lit("{}").alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert_same(scale_queries.QUERIES[name][0](spark, str(tmp_path)), con, scale_queries.QUERIES[name][1])


def test_every_offer_holds_once_begun(spark, tmp_path):
    """An event at each place where an offer begins finds it: no part is left out by an end before its begin."""
    part = spark.range(1, 400).select(F.col("id").alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")], (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    at = F.explode(F.array(F.lit(scale_queries.START), scale_queries.START + (F.col("id") * 7919) % 2_592_000))
    events = spark.range(1, 400).select("id", at.alias("at")).select(
        F.monotonically_increasing_id().alias("event_id"), F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")
    )
    con = duckdb.connect()
    for name, df in (("part", part), ("events", events)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = scale_queries.offered(spark, str(tmp_path))
    assert {r.part for r in got.select("part").distinct().collect()} == set(range(1, 400))
    assert_same(got, con, scale_queries.QUERIES["J14_interval_join"][1])


def test_one_bin_is_many_tasks(spark):
    """All rows at a few places, so in a few bins."""
    points = spark.range(13_000).select("id", (F.col("id") % 10).alias("at"))
    some = spark.range(40).select("id", F.when(F.col("id") % 2 == 0, 0).cast("bigint").alias("begin"), F.when(F.col("id") % 3 == 0, 9).cast("bigint").alias("end"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = overlaps(points, some, ("at", "at"), ("begin", "end")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sum(r["count"] for r in made) == 13_000 * 40 and max(r["count"] for r in made) < 13_000 * 40 / 8


def test_arrays_of_a_bin_are_bounded(spark):
    """Rows that are all alike, and some of another level."""
    rows = spark.range(3_000).select(F.lit(7).alias("id"), F.lit(5).cast("bigint").alias("begin"), F.when(F.col("id") % 100 == 0, 900).otherwise(6).cast("bigint").alias("end"))
    side = I._side(rows, "begin", "end", [], "right", (0, 1_000))
    blocks = I._blocks(side, [0], ["level", "bin"]).withColumn("n", F.size("block"))
    assert blocks.agg(F.max("n")).first()[0] <= I.BLOCK
    assert {tuple(r) for r in blocks.filter("right_level = 0").groupBy("level", "bin").agg(F.sum("n")).collect()} == {(0, 5, 2_970), (0, 6, 2_970)}


def test_events_without_time_find_no_offer(spark, tmp_path):
    rows = [(1, None), (2, scale_queries.START + 100), (3, None)]
    events = spark.createDataFrame(rows, "event_id bigint, at bigint").select("event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"))
    part = spark.range(9, 300).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 5 > 0, F.col("id") % 50).cast("int").alias("p_size"))
    con = duckdb.connect()
    for name, df in (("part", part), ("events", events)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert_same(scale_queries.offered(spark, str(tmp_path)), con, scale_queries.QUERIES["J14_interval_join"][1])
