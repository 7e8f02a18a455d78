"""Nested writes, stored results, rule checks, join forms and further stream and scalar queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import aggregates as A
from brindle.operators import nested_writes as W
from brindle.operators import paging as P
from brindle.operators import snapshots as M
from brindle.operators.ranks import values_at
from brindle.plans.ledger_queries import CU, customers
from brindle.plans.relation_queries import OC, o_cents
from brindle.plans.stream_queries import PR, _run_stream, progress
from brindle.session import shared_dir
from brindle.sources.tables import SCHEMAS, table
from brindle.streaming import progress as T

KEPT = 1_706_500_000_000 + 1000 * T.RESULT_TTL_S


def flag_lists(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))


def in_debt(s: SparkSession, d: str) -> DataFrame:
    return customers(s, d).filter("bal < 0")


def nested_many(s: SparkSession, d: str) -> DataFrame:
    """Customers in debt: their pending orders go, their fulfilled ones become free, and each gets a new order."""
    orders = o_cents(s, d).select("o_orderkey", "o_custkey", "o_orderstatus", "total")
    new = {"o_orderkey": -F.col("c_custkey"), "o_orderstatus": F.lit("O"), "total": F.lit(0)}
    return M.write_children(in_debt(s, d), "c_custkey", orders, "o_custkey", create=new, update=({"o_orderstatus": "F"}, {"total": 0}), delete={"o_orderstatus": "P"})


def short_orders(s: SparkSession, d: str) -> DataFrame:
    return o_cents(s, d).select("o_orderkey", "o_custkey", "o_orderstatus", "total")


def wanted_orders(s: SparkSession, d: str) -> DataFrame:
    """Orders that suppliers ask for, for a customer each: some of the keys are taken, some asked for twice."""
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select((k - k % 2).cast("bigint").alias("key"), k.alias("pos")).select((F.col("key") * 400).alias("o_orderkey"), (F.col("pos") * 20).alias("o_custkey"), F.lit("N").alias("o_orderstatus"), F.col("pos").alias("total"), "pos")


WANTED = OC.rstrip().rstrip(",") + """, so as (select o_orderkey, o_custkey, o_orderstatus, total from oc),
wn as (select (s_suppkey - s_suppkey % 2) * 400 as o_orderkey, s_suppkey * 20 as o_custkey, 'N' as o_orderstatus, s_suppkey as total from supplier),
w1 as (select * from wn qualify row_number() over (partition by o_orderkey order by total) = 1)
"""


def order_update() -> dict:
    return {"total": F.col("total") + F.col("_w_total"), "o_orderstatus": F.lit("U")}


def wanted_by_owner(s: SparkSession, d: str) -> DataFrame:
    """As wanted_orders, but every third for the customer who has the order."""
    owner = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("owner"))
    w = wanted_orders(s, d).join(owner, F.col("o_orderkey") == F.col("k"), "left")
    return w.withColumn("o_custkey", F.when(F.col("pos") % 3 > 0, F.coalesce("owner", "o_custkey")).otherwise(F.col("o_custkey"))).drop("k", "owner")


def parents_wanted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pending orders ask for a customer by a number of their own, part of which are new."""
    o = guests(s, d).select("o_orderkey", "fk", "o_custkey")
    wanted = o.filter("fk is null").select(F.col("o_orderkey").alias("_child"), (F.col("o_custkey") + 700).alias("c_custkey"), F.concat(F.lit("Guest "), F.col("o_orderkey").cast("string")).alias("c_name"), F.lit(0).alias("bal"))
    return W.connect_or_create_parent(o, "o_orderkey", "fk", customers(s, d), "c_custkey", wanted)


def parents_upserted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = guests(s, d).filter("o_orderstatus <> 'O'").select("o_orderkey", "fk")
    return W.upsert_parent(o, "fk", customers(s, d), "c_custkey", {"bal": F.col("bal") + 1}, {"c_custkey": -F.col("o_orderkey"), "c_name": F.lit("Guest"), "bal": F.lit(0)})


def guests(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").withColumn("fk", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))


def done_jobs(s: SparkSession, d: str) -> DataFrame:
    """Jobs whose last event is done: job_id, result, completed_at in milliseconds."""
    p = progress(s, d)
    ends = T.until_terminal(p).groupBy("job_id").agg(F.max("seq").alias("last")).withColumnRenamed("job_id", "_j")
    when = table(s, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("completed_at"))
    done = T.fold(p).filter("stage = 'done'").join(ends, F.col("job_id") == F.col("_j"))
    return done.join(when, F.col("last") == F.col("event_id")).select("job_id", "result", "completed_at")


def result_sink(s: SparkSession, d: str) -> DataFrame:
    """The key/value rows as written to the shared folder and read again."""
    path = f"{shared_dir(s)}/results-{uuid.uuid4().hex}"
    T.store_results(done_jobs(s, d)).write.parquet(path)
    return s.read.parquet(path)


DONE = PR + """, dn as (select x.job_id, x.result, epoch_us(e.ts) // 1000 as completed_at from (select job_id, arg_max(stage, seq) as stage, arg_max(result, seq) filter (result is not null) as result, max(seq) as last from lv group by 1) x join events e on e.event_id = x.last where x.stage = 'done')"""


def projection_modes(s: SparkSession, d: str) -> DataFrame:
    """Every part asks for a projection of its own: by its size with select, omit, both or neither, some with an unknown field."""
    size, fields = F.col("p_size"), ["p_partkey", "p_name", "p_brand", "p_type"]
    some = F.array(F.lit("p_name"), F.when(size % 5 == 0, "p_colour").otherwise("p_brand"))
    problem, kept = P.kept_fields(fields, F.when(size % 2 == 0, some), F.when(size % 3 == 0, some))
    return table(s, d, "part").select("p_partkey", problem.alias("problem"), F.array_join(kept, ",").alias("kept"))


def group_rules(s: SparkSession, d: str) -> DataFrame:
    """Every order asks for groups: its keys, what it has in having and order, and whether it pages, by its number."""
    k = F.col("o_orderkey")
    by = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.lit("pri"))).otherwise(F.array(F.lit("pri"), F.lit("o_custkey")))
    used = F.array_compact(F.array(F.when(k % 3 == 0, "o_custkey"), F.when(k % 5 == 0, "sum_total"), F.when(k % 11 == 0, "total")))
    problem = A.group_problem(by, used, ["n", "sum_total", "max_total"], k % 13 == 0, k % 5 == 0)
    return table(s, d, "orders").select("o_orderkey", problem.alias("problem"))


def events_stream(s: SparkSession, d: str) -> DataFrame:
    return T.read_jobs(s, d, SCHEMAS["events"], "events.parquet")


def stream_join(s: SparkSession, d: str) -> DataFrame:
    e = events_stream(s, d)
    return _run_stream(T.joined_streams(e.filter("event_type = 'purchase'"), events_stream(s, d).filter("event_type = 'click'"), "user_id", "ts"), "append")


def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    """Every event comes twice."""
    both = events_stream(s, d).union(events_stream(s, d))
    return _run_stream(T.distinct_events(both), "append").select("event_id", "user_id", "event_type")


def close(approx, exact, share: float):
    return F.abs(approx - exact) <= share * exact


def approximate(s: SparkSession, d: str) -> DataFrame:
    """Whether estimates of each flag are close to the exact figures. Each is an aggregate of its own: beside a distinct
    count, the others' buffers would be kept for each flag and part."""
    li = table(s, d, "lineitem")
    guess = li.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("guessed"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("guessed_median"))
    parts = li.groupBy(F.col("l_returnflag").alias("_p")).agg(F.countDistinct("l_partkey").alias("parts"))
    middle = values_at(li, ["l_returnflag"], "l_extendedprice", lambda n: F.array_distinct(F.array(F.floor((n + 1) / 2), F.floor(n / 2) + 1)))
    middle = middle.select(F.col("l_returnflag").alias("_m"), ((F.col("found")[0] + F.element_at("found", -1)) / 2).alias("median"))
    flag = F.col("l_returnflag")
    both = guess.join(parts, flag.eqNullSafe(F.col("_p"))).join(middle, flag.eqNullSafe(F.col("_m")), "left")
    return both.select(flag, close(F.col("guessed"), F.col("parts"), 0.1).alias("distinct_close"), close(F.col("guessed_median"), F.col("median"), 0.02).alias("median_close"))


QUERIES = {
    "M10_array_set": (
        lambda s, d: M.update_many(flag_lists(s, d), {"f": {"has": "R"}}, {"f": M.assign("X", "Y")}).rows.select("l_orderkey", F.array_join("f", "").alias("f")),
        "with l as (select l_orderkey, list_sort(list(distinct l_returnflag)) as f from lineitem group by 1) select l_orderkey, case when list_contains(f, 'R') then 'XY' else array_to_string(f, '') end as f from l",
    ),
    "M12_nested_many": (nested_many, OC + ", " + CU + ", neg as (select c_custkey from cu where bal < 0) select o_orderkey, o_custkey, o_orderstatus, case when o_orderstatus = 'F' and o_custkey in (select c_custkey from neg) then 0 else total end as total from oc where not (o_orderstatus = 'P' and o_custkey in (select c_custkey from neg)) union all select -c_custkey, c_custkey, 'O', 0 from neg"),
    "M13_nested_one_update": (
        lambda s, d: M.write_parents(table(s, d, "orders").filter("o_totalprice > 400000"), "o_custkey", customers(s, d), "c_custkey", update={"c_mktsegment": "BIG"}),
        "with " + CU + "select c_custkey, c_name, bal, case when c_custkey in (select o_custkey from orders where o_totalprice > 400000) then 'BIG' else c_mktsegment end as c_mktsegment from cu",
    ),
    "M13_nested_one_create": (
        lambda s, d: M.write_parents(guests(s, d), "fk", customers(s, d), "c_custkey", create={"c_custkey": -F.col("o_orderkey"), "c_name": F.lit("Guest"), "bal": F.lit(0)}),
        "with " + CU + "select * from cu union all select -o_orderkey, 'Guest', 0, null from orders where o_orderstatus = 'P'",
    ),
    "S21_result_sink": (result_sink, "with " + DONE + """ select 'job:' || job_id || ':result' as key, '{' || coalesce('"report":"' || result || '",', '') || '"completedAt":' || completed_at || '}' as value, completed_at as at, completed_at + 604800000 as expires_at from dn"""),
    "S22_stored_result": (lambda s, d: T.read_results(T.store_results(done_jobs(s, d)), KEPT), "with " + DONE + f" select cast(job_id as varchar) as job_id, result as report, completed_at from dn where completed_at + 604800000 >= {KEPT}"),
    "P10_projection_modes": (
        projection_modes,
        """select p_partkey, case when p_size % 6 = 0 then 'select and omit' when p_size % 5 = 0 and (p_size % 2 = 0 or p_size % 3 = 0) then 'unknown field' end as problem,
 case when p_size % 6 = 0 or (p_size % 5 = 0 and (p_size % 2 = 0 or p_size % 3 = 0)) then null when p_size % 2 = 0 then 'p_name,p_brand' when p_size % 3 = 0 then 'p_partkey,p_type' else 'p_partkey,p_name,p_brand,p_type' end as kept from part""",
    ),
    "A9_group_rules": (
        group_rules,
        """select o_orderkey, case when o_orderkey % 7 = 0 then 'by must not be empty' when o_orderkey % 13 = 0 and o_orderkey % 5 <> 0 then 'skip and take need order_by'
 when o_orderkey % 6 = 0 and o_orderkey % 11 = 0 then 'not in by: o_custkey, total' when o_orderkey % 6 = 0 then 'not in by: o_custkey' when o_orderkey % 11 = 0 then 'not in by: total' end as problem from orders""",
    ),
    "J13_left_merge": (lambda s, d: table(s, d, "customer").select("c_custkey").join(o_cents(s, d).filter("o_orderstatus = 'P'").hint("merge"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey"), OC + "select c_custkey, o_orderkey from customer left join oc on o_custkey = c_custkey and o_orderstatus = 'P'"),
    "J13_right_hash": (lambda s, d: table(s, d, "customer").filter("c_acctbal < 0").hint("shuffle_hash").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "right").select("o_orderkey", "c_name"), "select o_orderkey, c_name from (select * from customer where c_acctbal < 0) right join orders on c_custkey = o_custkey"),
    "A17_approximate": (
        approximate,
        "select distinct l_returnflag, true as distinct_close, true as median_close from lineitem",
    ),
    "X20_maps_trigonometry": (
        lambda s, d: table(s, d, "part").withColumn("m", F.map_concat(F.create_map(F.lit("size"), F.col("p_size")), F.create_map(F.lit("twice"), F.col("p_size") * 2))).select(
            "p_partkey", F.element_at("m", "twice").alias("twice"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.aggregate(F.map_values("m"), F.lit(0), lambda x, y: x + y).alias("total"), F.round(F.sin("p_size") + F.atan2(F.col("p_size"), F.lit(10)), 6).alias("t")
        ),
        "select p_partkey, p_size * 2 as twice, 'size,twice' as keys, p_size * 3 as total, round(sin(p_size) + atan2(p_size, 10), 6) as t from part",
    ),
    "T7_retry_log": (
        lambda s, d: T.retries(table(s, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error").select("event_id", "attempt", "retry_ms", "given_up"),
        "with e as (select event_id, row_number() over (partition by user_id order by ts, event_id) as attempt from events where event_type = 'error') select event_id, cast(attempt as int) as attempt, cast(case when attempt < 3 then 2000 * 2 ** (attempt - 1) end as bigint) as retry_ms, attempt >= 3 as given_up from e",
    ),
    "T14_sliding_windows": (
        lambda s, d: T.sliding_counts(table(s, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"),
        "with e as (select event_type, date_trunc('day', ts)::timestamp + case when hour(ts) >= 12 then interval 12 hour else interval 0 hour end as h from events) select h - k * interval 12 hour as start, event_type, count(*) as n from e, (values (0), (1)) t(k) group by 1, 2",
    ),
    "T14_stream_join": (stream_join, "select p.event_id as left_id, c.event_id as right_id from events p join events c on c.user_id = p.user_id and c.ts <= p.ts and c.ts >= p.ts - interval 1 hour where p.event_type = 'purchase' and c.event_type = 'click'"),
    "T14_stream_dedup": (stream_dedup, "select event_id, user_id, event_type from events"),
    "M12_connect_or_create": (lambda s, d: W.connect_or_create(short_orders(s, d), wanted_orders(s, d), "o_orderkey", "o_custkey", "pos").rows, WANTED + "select so.o_orderkey, coalesce(w1.o_custkey, so.o_custkey) as o_custkey, so.o_orderstatus, so.total from so left join w1 using (o_orderkey) union all select * from w1 where o_orderkey not in (select o_orderkey from so)"),
    "M12_nested_upsert": (
        lambda s, d: W.upsert(short_orders(s, d), wanted_by_owner(s, d), "o_orderkey", "o_custkey", order_update(), "pos").rows,
        WANTED + ", w2 as (select w1.o_orderkey, case when w1.total % 3 > 0 then coalesce(so.o_custkey, w1.o_custkey) else w1.o_custkey end as o_custkey, w1.o_orderstatus, w1.total from w1 left join so using (o_orderkey)) select so.o_orderkey, so.o_custkey, case when w2.o_custkey = so.o_custkey then 'U' else so.o_orderstatus end as o_orderstatus, so.total + case when w2.o_custkey = so.o_custkey then w2.total else 0 end as total from so left join w2 using (o_orderkey) union all select * from w2 where o_orderkey not in (select o_orderkey from so)",
    ),
    "M12_nested_create_many": (lambda s, d: W.create_many(short_orders(s, d), wanted_orders(s, d), "o_orderkey", "o_custkey", customers(s, d), "c_custkey", "pos", skip_duplicates=True).changed, WANTED + "select * from wn where o_custkey in (select c_custkey from customer) and o_orderkey not in (select o_orderkey from so) qualify row_number() over (partition by o_orderkey order by total) = 1"),
    "M13_connect_or_create": (lambda s, d: parents_wanted(s, d)[1], "with " + CU + "select * from cu union all select c_custkey, 'Guest ' || k, 0, null from (select o_custkey + 700 as c_custkey, min(o_orderkey) as k from orders where o_orderstatus = 'P' group by 1) where c_custkey not in (select c_custkey from cu)"),
    "M13_connected_children": (lambda s, d: parents_wanted(s, d)[0].select("o_orderkey", "fk"), "select o_orderkey, case when o_orderstatus = 'P' then o_custkey + 700 else o_custkey end as fk from orders"),
    "M13_nested_upsert": (lambda s, d: parents_upserted(s, d)[1], "with " + CU + "select c_custkey, c_name, bal + case when c_custkey in (select o_custkey from orders where o_orderstatus = 'F') then 1 else 0 end as bal, c_mktsegment from cu union all select -o_orderkey, 'Guest', 0, null from orders where o_orderstatus = 'P'"),
    "M13_upserted_children": (lambda s, d: parents_upserted(s, d)[0], "select o_orderkey, case when o_orderstatus = 'P' then -o_orderkey else o_custkey end as fk from orders where o_orderstatus <> 'O'"),
}
