"""Truth tables, boundaries and properties that the test tables don't reach."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.functions.predicates import ANY_NULL, DB_NULL, JSON_NULL, Field, Json, unique_where, where
from brindle.functions.scalars import minor_units, normalise_code
from brindle.operators import aggregates as A
from brindle.operators import ledger as E
from brindle.operators import paging as P
from brindle.operators import relations as R
from brindle.operators import snapshots as M
from brindle.operators import signals as S
from brindle.operators.windows import carried_before
from brindle.streaming import progress as T


@pytest.fixture(scope="module")
def grid(spark):
    texts = [None, "", "abc", "ABC", "a%c", "a_c", "a\\c"]
    return spark.createDataFrame([(i, t, n) for i, t in enumerate(texts) for n in (None, 1, 5)], "id int, t string, n int").cache()


def ids(df):
    return sorted({r.id for r in df.collect()})


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        ({"t": None}, [0]), ({"t": {"not": None}}, [1, 2, 3, 4, 5, 6]), ({"t": {"not": "abc"}}, [1, 3, 4, 5, 6]), ({"t": {"in": []}}, []),
        ({"t": {"notIn": []}}, [1, 2, 3, 4, 5, 6]), ({"t": {"contains": "%"}}, [4]), ({"t": {"contains": "_"}}, [5]), ({"t": {"endsWith": "\\c"}}, [6]),
        ({"t": {"startsWith": "ab", "mode": "insensitive"}}, [2, 3]), ({"OR": []}, []), ({"AND": [], "NOT": []}, [0, 1, 2, 3, 4, 5, 6]), ({"NOT": [{"t": {"in": ["abc", ""]}}]}, [3, 4, 5, 6]),
        ({"t": {"equals": Field("t")}}, [1, 2, 3, 4, 5, 6]),
    ],
)
def test_filters(grid, spec, expected):
    assert ids(grid.filter(where(spec))) == expected


def test_where_plus_not_plus_unknown_is_everything(grid):
    spec = {"n": {"gt": 1}}
    assert grid.filter(where(spec)).count() + grid.filter(where({"NOT": spec})).count() + grid.filter(where(spec).isNull()).count() == grid.count()


def test_lists_and_json(spark):
    df = spark.createDataFrame([(1, None, None), (2, [], "null"), (3, ["a"], '{"a": {"b": "Xy"}, "l": [1, 2]}'), (4, ["a", "b"], "{bad"), (5, ["b"], '{"a": null, "l": []}')], "id int, l array<string>, j string")
    assert ids(df.filter(where({"l": {"isEmpty": True}}))) == [2]
    assert ids(df.filter(where({"l": {"hasEvery": []}}))) == [2, 3, 4, 5]
    assert ids(df.filter(where({"l": {"hasSome": []}}))) == []
    assert ids(df.filter(where({"l": ["a", "b"]}))) == [4]
    assert ids(df.filter(where({"j": Json({"equals": DB_NULL})}))) == [1]
    assert ids(df.filter(where({"j": Json({"equals": JSON_NULL})}))) == [2]
    assert ids(df.filter(where({"j": Json({"equals": ANY_NULL})}))) == [1, 2]
    assert ids(df.filter(where({"j": Json({"string_contains": "xY", "mode": "insensitive"}, ("a", "b"))}))) == [3]
    assert ids(df.filter(where({"j": Json({"array_contains": 2}, ("l",))}))) == [3]
    assert ids(df.filter(where({"j": Json({"array_starts_with": 1, "array_ends_with": 2}, ("l",))}))) == [3]


def test_json_kinds(spark):
    values = ["1", "1.0", '"1"', "true", '"true"', "null", "[1]", '["1"]', "[1, 2]", '{"b": 1, "c": 2}', "[]", "15"]
    rows = [(k, '{"a": ' + v + "}") for k, v in enumerate(values)] + [(20, "{}"), (21, None), (22, "{bad"), (23, "null")]
    df = spark.createDataFrame(rows, "id int, j string").withColumn("other", F.lit('{"c": 2, "b": 1}'))

    def found(*path, **ops):
        return ids(df.filter(where({"j": Json(ops, path)})))

    assert found("a", equals=1) == [0, 1] and found("a", equals=1.0) == [0, 1] and found("a", equals="1") == [2]
    assert found("a", equals=True) == [3] and found("a", equals="true") == [4] and found("a", equals=None) == [5]
    assert found("a", equals=[1]) == [6] and found("a", equals={"c": 2, "b": 1}) == [9] and found("a", equals=Field("other")) == [9]
    assert found("a", equals=DB_NULL) == [20, 21, 22, 23] and found("a", equals=JSON_NULL) == [5] and found("a", equals=ANY_NULL) == [5, 20, 21, 22, 23]
    assert found(equals=DB_NULL) == [21] and found(equals=JSON_NULL) == [23] and found(equals=ANY_NULL) == [21, 23]
    assert found("a", **{"not": 1}) == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11] and found("a", **{"not": ANY_NULL}) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert found("a", array_contains=1) == [6, 8] and found("a", array_contains="1") == [7] and found("a", array_contains=[1, 2]) == [8]
    assert found("a", array_contains=[]) == [6, 7, 8, 10] and found("a", array_starts_with=1) == [6, 8] and found("a", array_ends_with=2) == [8]
    assert found("a", string_contains="1") == [2] and found("a", string_starts_with="TR", mode="insensitive") == [4]
    assert found("a", gte=1) == [0, 1, 11] and found("a", gte="1") == [2, 4] and found("a", lt=10) == [0, 1]
    assert found("a", 1, equals=2) == [8] and found("it's", equals=DB_NULL) == [k for k, _ in rows]
    with pytest.raises(ValueError):
        found("a\"'", equals=1)


def test_unique_needs_a_key(spark):
    with pytest.raises(ValueError):
        unique_where({"b": 1}, [("a",)])
    with pytest.raises(P.NotFound):
        P.or_throw(spark.range(3).filter("id = 9"))
    with pytest.raises(ValueError):
        P.project(spark.range(1), select=["id"], omit=["id"])


def test_quantifiers(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "k int")
    children = spark.createDataFrame([(2, 9), (2, 8), (3, 9), (3, 1), (4, 1), (5, None), (None, 9)], "fk int, v int")
    spec = {"v": {"gt": 5}}
    keys = lambda df: sorted([r.k for r in df.collect()], key=str)
    assert keys(R.some(parents, "k", children, "fk", spec)) == [2, 3]
    assert keys(R.none(parents, "k", children, "fk", spec)) == [1, 4, 5, None]
    assert keys(R.every(parents, "k", children, "fk", spec)) == [1, 2, None]


def test_pages_concatenate_to_the_scan(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(40)], "id int, v int")
    for order in ([("v", "asc")], [("v", "desc")], [("v", "asc", "first")], [("v", "desc", "last")]):
        whole = [r.id for r in P.find_many(df, ["id"], order_by=order).collect()]
        got, cursor = [], None
        while True:
            page = [r.id for r in P.find_many(df, ["id"], order_by=order, cursor=None if cursor is None else {"id": cursor}, skip=0 if cursor is None else 1, take=7).collect()]
            if not page:
                break
            got, cursor = got + page, page[-1]
        assert got == whole
        assert [r.id for r in P.find_many(df, ["id"], order_by=order, take=-4).collect()] == whole[-4:]
    assert P.find_many(df, ["id"], take=0).count() == 0
    assert P.find_many(df, ["id"], distinct=["v"]).count() == 4
    assert P.find_many(df, ["id"], skip=99).count() == 0


def test_group_rules(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "g string, v int")
    assert A.group_by(df, ["g"], {"sum": ["v"]}).count() == 2
    for bad in ({"by": []}, {"by": ["g"], "having": {"v": 1}}, {"by": ["g"], "take": 1}):
        with pytest.raises(ValueError):
            A.group_by(df, wanted={"sum": ["v"]}, **bad)
    e = df.agg(A.enum_min("g", ["b", "a"]).alias("lo")).first()
    assert e.lo == "a"


NOW = datetime(2024, 1, 15)
DAY = timedelta(days=1)
BASE = {"code": "C", "status": "ACTIVE", "redemption_type": "DIRECT_REDEEM", "credit_amount": 5, "max_uses": None, "used_count": 0, "per_user_limit": 1, "starts_at": None, "expires_at": None, "used_by_user": 0}
CASES = [
    ("DIS", {"status": "DISABLED"}, "Coupon inactive", "Coupon inactive"),
    ("FUT", {"starts_at": NOW + DAY}, "Coupon not started", "Coupon not started"),
    ("START_EQ", {"starts_at": NOW}, None, None),
    ("PAST", {"expires_at": NOW - DAY}, "Coupon expired", "Coupon expired"),
    ("END_EQ", {"expires_at": NOW}, None, None),
    ("FULL", {"max_uses": 3, "used_count": 3}, "Coupon exhausted", "Coupon exhausted"),
    ("ZEROMAX", {"max_uses": 0}, "Coupon exhausted", "Coupon exhausted"),
    ("UNLIM", {"used_count": 99}, None, None),
    ("LIM", {"used_by_user": 1}, "Redemption limit reached", "Redemption limit reached"),
    ("CHK", {"redemption_type": "CHECKOUT"}, None, "Coupon requires checkout"),
    ("CHK_PAST", {"redemption_type": "CHECKOUT", "expires_at": NOW - DAY}, "Coupon expired", "Coupon requires checkout"),
    ("NOCRED", {"credit_amount": None}, None, "Coupon has no redeemable credits"),
    ("NOCRED_PAST", {"credit_amount": None, "expires_at": NOW - DAY}, "Coupon expired", "Coupon has no redeemable credits"),
    ("ZERO", {"credit_amount": 0}, None, None),
    ("FULL_LIM", {"max_uses": 1, "used_count": 1, "used_by_user": 1}, "Coupon exhausted", "Coupon exhausted"),
    ("(absent)", {"status": None}, "No coupon found", "Invalid coupon"),
]


def test_ladders(spark):
    schema = "name string, code string, status string, redemption_type string, credit_amount int, max_uses int, used_count int, per_user_limit int, starts_at timestamp_ntz, expires_at timestamp_ntz, used_by_user int"
    df = spark.createDataFrame([(n, *(BASE | x).values()) for n, x, _, _ in CASES], schema)
    at = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    got = {r.name: r for r in E.inspect(df, at).withColumn("redeem", E.redeem_reason(at)).collect()}
    for name, _, inspect, redeem in CASES:
        assert (got[name].reason, got[name].redeem) == (inspect, redeem), name
    assert got["ZERO"].redeemable and not got["CHK"].redeemable and got["LIM"].valid and not got["LIM"].redeemable
    assert got["UNLIM"].remaining_uses is None and got["UNLIM"].per_user_remaining == 1


def test_replay_keeps_limits(spark):
    schema = "coupon_id bigint, code string, status string, redemption_type string, credit_amount int, max_uses int, used_count int, per_user_limit int, starts_at timestamp_ntz, expires_at timestamp_ntz"
    coupons = spark.createDataFrame([(1, "A", "ACTIVE", "DIRECT_REDEEM", 5, 4, 1, 2, None, None)], schema)
    attempts = spark.createDataFrame([(i, i % 3, 1, NOW + timedelta(minutes=i // 2)) for i in range(12)], "attempt_id bigint, user_id bigint, coupon_id bigint, at timestamp_ntz")
    usages = spark.createDataFrame([(0, 1)], "user_id bigint, coupon_id bigint")
    got = sorted(E.redeem_log(attempts, coupons, usages).collect(), key=lambda r: r.attempt_id)
    used, by_user, expected = 1, {0: 1}, []
    for r in sorted(attempts.collect(), key=lambda r: (r.at, r.attempt_id)):
        reason = "Coupon exhausted" if used >= 4 else "Redemption limit reached" if by_user.get(r.user_id, 0) >= 2 else None
        if reason is None:
            used, by_user[r.user_id] = used + 1, by_user.get(r.user_id, 0) + 1
        expected.append(reason)
    assert [r.reason for r in got] == expected


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, t string, n int")
    assert {tuple(r) for r in M.create(df, {"k": 3}).rows.collect()} == {(1, "a", 5), (2, "b", None), (3, None, None)}
    assert {r.n for r in M.update_many(df, None, {"n": M.increment("n", 1)}).rows.collect()} == {6, None}
    assert M.delete_many(df, {"n": {"gt": 1}}).rows.count() == 1  # an unknown condition doesn't delete
    assert spark.createDataFrame([(-7,)], "n int").select(M.divide("n", 2)).first()[0] == -3
    at = str(tmp_path / "snap")
    M.publish(spark, df, at, "b1")
    M.publish(spark, df.limit(0), at, "b1")
    assert spark.read.parquet(at).count() == 2
    M.publish(spark, df.limit(1), at, "b2")
    assert spark.read.parquet(at).count() == 1


def test_scalars(spark):
    df = spark.createDataFrame([(" \tab﻿ ", -123456), (None, 5), ("", 0)], "c string, n int")
    assert [tuple(r) for r in df.select(normalise_code(F.col("c")), minor_units(F.col("n"))).collect()] == [("AB", "-$1,234.56"), (None, "$0.05"), ("", "$0.00")]


def test_progress(spark):
    rows = [(1, 1, '{"stage":"thinking"}'), (1, 2, "{bad"), (1, 3, '{"stage":"done"}'), (2, 1, '{"stage":"researching","result":"x"}'), (2, 2, '{"stage":"done"}'), (2, 3, '{"stage":"error"}'), (3, 1, '{"stage":"odd"}')]
    m = spark.createDataFrame(rows, "job_id bigint, seq bigint, message string")
    got = {r.job_id: (r.stage, r.result, r.error, r.events) for r in T.fold(T.parse(m)).collect()}
    assert got == {1: ("error", None, "Invalid message", 2), 2: ("done", "x", None, 2), 3: ("error", None, "Invalid message", 1)}


def test_kv_is_alive_at_its_end(spark):
    s = spark.createDataFrame([("a", "1", 10, 20), ("b", "2", 10, 19)], "key string, value string, at bigint, expires_at bigint")
    assert [r.key for r in T.kv_live(s, 20).collect()] == ["a"]


def test_merge_new_is_idempotent(spark):
    old = spark.createDataFrame([("h1", 1)], "content_hash string, doc_id int")
    new = spark.createDataFrame([("h1", 2), ("h2", 3), ("h2", 3)], "content_hash string, doc_id int")
    once = S.merge_new(old, new)
    assert once.count() == 2 and S.merge_new(once, new).count() == 2


def test_stream_rows_lie_in_files(spark, sf_dir):
    from brindle.plans import stream_queries

    for query in (stream_queries.stream_fold, stream_queries.stream_windows):
        assert all("/rows/" in f for f in query(spark, sf_dir).inputFiles()) and query(spark, sf_dir).inputFiles()


def test_carried_before(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(60), i, rng.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at int, id int, v int")
    got = {r.id: (r.s, r.l) for r in carried_before(carried_before(df, ["k"], ["at", "id"], F.floor(F.col("at") / 10), F.col("v"), "s"), ["k"], ["at", "id"], F.floor(F.col("at") / 7), F.col("v"), "l", last=True).collect()}
    for k, at, i, _ in rows:
        before = [v for kk, a, j, v in sorted(rows, key=lambda r: (r[1], r[2])) if kk == k and (a, j) < (at, i) and v is not None]
        assert got[i] == (sum(before), before[-1] if before else None)
    assert len(got) == len(rows)


def test_nested_writes(spark):
    parents = spark.createDataFrame([(1, "p"), (2, "q")], "k int, name string")
    children = spark.createDataFrame([(10, 1, "a", 5), (11, 1, "b", 5), (12, 2, "a", 5), (13, None, "a", 5), (14, 1, "c", 5)], "id int, fk int, kind string, n int")
    out = M.write_children(parents.filter("k = 1"), "k", children, "fk", create={"id": F.col("k") + 100, "kind": F.col("name")}, update=({"kind": {"in": ["a", "c"]}}, {"n": M.increment("n", 1)}), disconnect={"kind": "a"}, delete={"kind": "b"})
    assert sorted(tuple(r) for r in out.select("id", F.coalesce("fk", F.lit(-1)), "kind", F.coalesce("n", F.lit(-1))).collect()) == [(10, -1, "a", 5), (12, 2, "a", 5), (13, -1, "a", 5), (14, 1, "c", 6), (101, 1, "p", -1)]
    both = M.write_parents(children.filter("id in (10, 13)"), "fk", parents, "k", update={"name": "x"}, create={"k": F.col("id"), "name": F.col("kind")})
    assert sorted(tuple(r) for r in both.collect()) == [(1, "x"), (2, "q"), (13, "a")]


def test_null_keys_are_no_duplicates(spark):
    old = spark.createDataFrame([(1, 0)], "k int, pos int")
    new = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4), (2, 5)], "k int, pos int")
    assert sorted((r.k is None, r.k or 0, r.pos) for r in M.create_many(old, new, [["k"]], True, "pos").changed.collect()) == [(False, 2, 4), (True, 0, 1), (True, 0, 2)]


def test_near_in_window(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], "t", NOW + timedelta(seconds=37 * i)) for i in range(60)]
    v = spark.createDataFrame(rows, "id int, v array<double>, topic string, at timestamp_ntz")
    got = {(r.new_id, r.old_id) for r in S.near_in_window(v, v, "id", "v", "at", "topic", 200, 0.9).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i) if (i - j) % 2 == 0 and 37 * (i - j) <= 200}


def test_stream_fold_over_batches(spark, tmp_path):
    """Rows of a micro-batch in any order; later micro-batches; nothing after the end counts."""
    from brindle.plans import stream_queries

    batches = [[(1, 3, "thinking", None), (1, 1, "processing", "a"), (2, 2, "done", "z"), (2, 1, "idle", None)], [(1, 5, "done", None), (1, 4, "researching", "b"), (2, 9, "idle", "late")], [(1, 6, "idle", "late")]]
    schema = "job_id bigint, seq bigint, stage string, result string, error string"
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r, None) for r in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    out = stream_queries._run_stream(T.fold_stream(events), "update").collect()
    last = {r.job_id: (r.stage, r.result, r.events) for r in sorted(out, key=lambda r: r.events)}
    assert last == {1: ("done", "b", 4), 2: ("done", "z", 2)}


def test_results_are_kept_for_a_time(spark):
    done = spark.createDataFrame([(1, "r", 1000), (2, None, 2000)], "job_id bigint, result string, completed_at bigint")
    kept = lambda now: sorted((r.job_id, r.report) for r in T.read_results(T.store_results(done), now).collect())
    end = 1000 + 1000 * T.RESULT_TTL_S
    assert kept(end) == [("1", "r"), ("2", None)] and kept(end + 1) == [("2", None)]


def test_kmeans_finds_the_groups(spark):
    """Well-parted groups: each is one cluster, and every vector's own mean is the nearest of all."""
    import random

    rng = random.Random(6)
    at = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    rows = [(i, [float(x + rng.uniform(-0.1, 0.1)) for x in at[i % 3]]) for i in range(90)]
    got = {r.id: r.cluster for r in S.kmeans(spark.createDataFrame(rows, "id int, v array<float>"), "v", k=3).collect()}
    assert len(got) == 90 and len({got[i] for i in range(3)}) == 3 and all(got[i] == got[i % 3] for i in got)
    means = {c: [sum(v[k] for i, v in rows if got[i] == c) / 30 for k in range(3)] for c in set(got.values())}
    assert all(min(means, key=lambda c: sum((x - y) ** 2 for x, y in zip(v, means[c], strict=True))) == got[i] for i, v in rows)
