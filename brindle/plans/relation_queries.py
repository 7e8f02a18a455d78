"""Relation, aggregate, window and paging queries."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.predicates import where
from brindle.functions.scalars import cents
from brindle.operators import aggregates as A
from brindle.operators import paging as P
from brindle.operators import relations as R
from brindle.sources.tables import table

PRIORITY = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")
BIG = {"o_orderstatus": "F", "o_totalprice": {"gt": 400000.0}}
SQL_BIG = "o_orderstatus = 'F' and o_totalprice > 400000"


def T(name: str):
    return lambda s, d: table(s, d, name)


def _quantified(fn, spec):
    return lambda s, d: fn(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey", spec).select("c_custkey", "c_name")


def o_cents(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", cents(F.col("o_totalprice")).alias("total"), "o_orderdate", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("pri"))


OC = "with oc as (select o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as total, o_orderdate, nullif(o_orderpriority, '5-LOW') as pri from orders) "


def nested_text(s, d):
    out = R.nest_many(table(s, d, "customer"), "c_custkey", o_cents(s, d), "o_custkey", "latest", ["o_orderkey", "total"], ["o_orderkey"], filter={"o_orderstatus": {"in": ["F", "O"]}}, order_by=[("o_orderdate", "desc")], take=3)
    return out.select("c_custkey", F.array_join(F.transform("latest", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["total"].cast("string"))), ",").alias("latest"))


def nested_one(s, d):
    out = R.nest_one(o_cents(s, d), "o_custkey", table(s, d, "customer"), "c_custkey", "user", ["c_name", "c_mktsegment"])
    return out.select("o_orderkey", F.col("user.c_name").alias("c_name"), F.col("user.c_mktsegment").alias("segment"))


def as_of_join(s, d):
    """For each purchase the latest earlier error of the same user: union and a window, no pairs."""
    e = table(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("last_error", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w))
    return e.filter("event_type = 'purchase'").select("event_id", "last_error")


def range_join(s, d):
    """Parts in price bands: an inequality join with a bounded band table (three rows)."""
    bands = s.createDataFrame([("low", 0.0, 1000.0), ("mid", 1000.0, 1500.0), ("high", 1500.0, 1e9)], "band string, lo double, hi double")
    p = table(s, d, "part")
    return p.join(F.broadcast(bands), (F.col("p_retailprice") >= F.col("lo")) & (F.col("p_retailprice") < F.col("hi"))).groupBy("band").agg(F.count("*").alias("n"))


def paged(**q):
    return lambda s, d: P.find_many(o_cents(s, d), ["o_orderkey"], **q)


COLS = ["o_orderkey", "total", "pri"]
QUERIES = {
    # sources and projection
    "S1_find_many": (lambda s, d: P.find_many(table(s, d, "part"), ["p_partkey"], filter={"p_size": {"gte": 40}}, order_by=["p_size"], select=["p_partkey", "p_name"]), "select p_partkey, p_name from part where p_size >= 40"),
    "S2_find_unique": (lambda s, d: P.find_unique(table(s, d, "customer"), [("c_custkey",)], {"c_custkey": 42}).select("c_custkey", "c_name"), "select c_custkey, c_name from customer where c_custkey = 42"),
    "S3_find_unique_or_throw": (lambda s, d: P.or_throw(P.find_unique(table(s, d, "customer"), [("c_custkey",)], {"c_custkey": 43})).select("c_custkey", "c_name"), "select c_custkey, c_name from customer where c_custkey = 43"),
    "S4_find_first": (lambda s, d: P.find_first(o_cents(s, d), ["o_orderkey"], filter={"o_orderstatus": "O"}, order_by=[("total", "desc")], select=COLS), OC + "select o_orderkey, total, pri from oc where o_orderstatus = 'O' order by total desc, o_orderkey limit 1"),
    "S5_find_first_or_throw": (lambda s, d: P.or_throw(P.find_first(o_cents(s, d), ["o_orderkey"], filter={"o_orderstatus": "P"}, order_by=["total"], select=COLS)), OC + "select o_orderkey, total, pri from oc where o_orderstatus = 'P' order by total, o_orderkey limit 1"),
    "S8_parameterised_sql": (lambda s, d: s.sql("select user_id, count(*) as n from {e} where event_type = :t group by user_id", args={"t": "click"}, e=table(s, d, "events")), "select user_id, count(*) as n from events where event_type = 'click' group by user_id"),
    "P1_select": (lambda s, d: P.project(table(s, d, "supplier"), select=["s_suppkey", "s_name"]), "select s_suppkey, s_name from supplier"),
    "P2_omit": (lambda s, d: P.project(table(s, d, "nation"), omit=["n_regionkey"]), "select n_nationkey, n_name from nation"),
    "P5_constants": (lambda s, d: table(s, d, "region").select("r_regionkey", F.lit("COUPON").alias("source"), F.lit(0).alias("reserved")), "select r_regionkey, 'COUPON' as source, 0 as reserved from region"),
    "P6_template": (lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit("Redeemed "), "p_brand").alias("note")), "select p_partkey, 'Redeemed ' || p_brand as note from part"),
    "P7_coalesce": (lambda s, d: o_cents(s, d).select("o_orderkey", F.coalesce("pri", F.lit("none")).alias("pri")), OC + "select o_orderkey, coalesce(pri, 'none') as pri from oc"),
    "P8_label_map": (lambda s, d: table(s, d, "events").select("event_id", F.coalesce(F.create_map(*[F.lit(x) for x in ("click", "Clicked", "view", "Viewed", "purchase", "Bought")])[F.col("event_type")], F.lit("Other")).alias("label")), "select event_id, case event_type when 'click' then 'Clicked' when 'view' then 'Viewed' when 'purchase' then 'Bought' else 'Other' end as label from events"),
    "P9_validation": (lambda s, d: table(s, d, "pages").select("page_id", (F.length("url").between(10, 60) & F.col("url").startswith("https")).alias("valid")), "select page_id, length(url) between 10 and 60 and starts_with(url, 'https') as valid from pages"),
    # relations
    "J1_is": (lambda s, d: R.is_(table(s, d, "orders"), "o_custkey", table(s, d, "customer"), "c_custkey", {"c_mktsegment": "BUILDING"}).select("o_orderkey"), "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"),
    "J2_is_not": (lambda s, d: R.is_not(table(s, d, "orders").withColumn("fk", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_custkey"))), "fk", table(s, d, "customer"), "c_custkey", {"c_mktsegment": "BUILDING"}).select("o_orderkey"), "select o_orderkey from orders where o_orderkey % 10 = 0 or o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')"),
    "J3_is_null": (lambda s, d: R.is_null(table(s, d, "orders").withColumn("fk", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_custkey"))), "fk").select("o_orderkey"), "select o_orderkey from orders where o_orderkey % 10 = 0"),
    "J4_some": (_quantified(R.some, BIG), f"select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and {SQL_BIG})"),
    "J4_none": (_quantified(R.none, BIG), f"select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and {SQL_BIG})"),
    "J4_every": (_quantified(R.every, {"o_totalprice": {"lt": 450000.0}}), "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and not (o_totalprice < 450000))"),
    "J5_nest_many": (nested_text, OC + "select c_custkey, coalesce(string_agg(o_orderkey || ':' || total, ',' order by rn), '') as latest from customer left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from oc where o_orderstatus in ('F', 'O')) on o_custkey = c_custkey and rn <= 3 group by 1"),
    "J6_nest_one": (nested_one, "select o_orderkey, c_name, c_mktsegment as segment from orders left join customer on o_custkey = c_custkey"),
    "J7_traverse": (lambda s, d: R.traverse(table(s, d, "supplier"), ("s_nationkey", table(s, d, "nation"), "n_nationkey"), ("n_regionkey", table(s, d, "region"), "r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n")), "select r_name, count(*) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1"),
    "J8_relation_count": (lambda s, d: R.relation_count(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey", "n", {"o_orderstatus": "P"}).select("c_custkey", "n"), "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P' group by 1"),
    "J9_list_lookup": (lambda s, d: R.list_lookup(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids")), "ids", table(s, d, "part"), "p_partkey", where({"p_size": {"gte": 20}})).select("p_partkey", "p_name"), "select p_partkey, p_name from part where p_size >= 20 and p_partkey in (select l_partkey from lineitem)"),
    "J13_left_right_full": (lambda s, d: table(s, d, "customer").filter("c_acctbal < 0").select("c_custkey").join(table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), F.col("c_custkey") == F.col("o_custkey"), "full"), "select c_custkey, o_custkey, n from (select c_custkey from customer where c_acctbal < 0) full join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey"),
    "J14_as_of": (as_of_join, "select p.event_id, (select e.event_id from events e where e.user_id = p.user_id and e.event_type = 'error' and (e.ts < p.ts or (e.ts = p.ts and e.event_id < p.event_id)) order by e.ts desc, e.event_id desc limit 1) as last_error from events p where p.event_type = 'purchase'"),
    "J14_range": (range_join, "select case when p_retailprice < 1000 then 'low' when p_retailprice < 1500 then 'mid' else 'high' end as band, count(*) as n from part group by 1"),
    # aggregates
    "A1_count": (lambda s, d: A.count_where(table(s, d, "orders"), {"o_orderstatus": "F"}), "select count(*) as n from orders where o_orderstatus = 'F'"),
    "A2_count_columns": (lambda s, d: A.aggregate(o_cents(s, d), ["o_orderkey"], {"count": ["*", "pri"]}), OC + "select count(*) as n, count(pri) as count_pri from oc"),
    "A3_aggregate_page": (lambda s, d: A.aggregate(o_cents(s, d), ["o_orderkey"], {"sum": ["total"], "count": ["*"]}, order_by=[("total", "desc")], skip=5, take=50), OC + "select cast(sum(total) as bigint) as sum_total, count(*) as n from (select total from oc order by total desc, o_orderkey limit 50 offset 5)"),
    "A4_sum_empty": (lambda s, d: A.aggregate(o_cents(s, d), ["o_orderkey"], {"sum": ["total"], "count": ["*"]}, filter={"o_orderstatus": "none"}), OC + "select cast(sum(total) as bigint) as sum_total, count(*) as n from oc where o_orderstatus = 'none'"),
    "A5_avg": (lambda s, d: o_cents(s, d).groupBy("o_orderstatus").agg(F.round(F.avg("total"), 4).alias("avg_total")), OC + "select o_orderstatus, round(avg(total), 4) as avg_total from oc group by 1"),
    "A6_enum_min_max": (lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(A.enum_min("o_orderpriority", PRIORITY).alias("lo"), A.enum_max("o_orderpriority", PRIORITY).alias("hi")), "select o_custkey, max(o_orderpriority) as lo, min(o_orderpriority) as hi from orders group by 1"),
    "A7_group_by": (lambda s, d: A.group_by(o_cents(s, d), ["pri", "o_orderstatus"], {"sum": ["total"], "min": ["total"], "max": ["o_orderdate"], "count": ["*"]}), OC + "select pri, o_orderstatus, cast(sum(total) as bigint) as sum_total, min(total) as min_total, max(o_orderdate) as max_o_orderdate, count(*) as n from oc group by 1, 2"),
    "A8_having_sum": (lambda s, d: A.group_by(o_cents(s, d), ["o_custkey"], {"sum": ["total"]}, having={"sum_total": {"gt": 300_000_000}}), OC + "select o_custkey, cast(sum(total) as bigint) as sum_total from oc group by 1 having sum(total) > 300000000"),
    "A10_order_by_aggregate": (lambda s, d: A.group_by(o_cents(s, d), ["o_custkey"], {"count": ["*"]}, order_by=[("sum_total", "desc")], skip=3, take=10), OC + "select o_custkey, count(*) as n from oc group by 1 order by sum(total) desc, o_custkey limit 10 offset 3"),
    "A11_having_combinators": (lambda s, d: A.group_by(o_cents(s, d), ["o_custkey"], {"count": ["*"]}, having={"OR": [{"n": {"gte": 20}}, {"AND": [{"n": {"lte": 3}}, {"NOT": [{"max_total": {"gt": 20_000_000}}]}]}]}), OC + "select o_custkey, count(*) as n from oc group by 1 having count(*) >= 20 or (count(*) <= 3 and not max(total) > 20000000)"),
    "A13_distinct_last_wins": (lambda s, d: A.distinct_last_wins(table(s, d, "conversations"), ["conv_id", "role"], "turn"), "select conv_id, role, min(turn) as turn, arg_max(text, turn) as text from conversations group by 1, 2"),
    "A14_per_ten": (lambda s, d: table(s, d, "part").select("p_partkey", F.ceil(F.col("p_size") / 10).cast("bigint").alias("n")), "select p_partkey, cast(ceil(p_size / 10) as bigint) as n from part"),
    "A17_distinct_aggregates": (lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers")), "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1"),
    "A18_cube": (lambda s, d: table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)"),
    "A18_rollup": (lambda s, d: table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("g")), "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) * 2 + grouping(l_linestatus) as bigint) as g from lineitem group by rollup (l_returnflag, l_linestatus)"),
    "A18_pivot": (lambda s, d: table(s, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1))), "select user_id, nullif(count(*) filter (event_type = 'click'), 0) as click, nullif(count(*) filter (event_type = 'view'), 0) as view from events group by 1"),
    # windows and order
    "W2_distinct_first": (paged(distinct=["o_custkey"], order_by=[("total", "desc")], skip=2, take=100, select=COLS), OC + "select o_orderkey, total, pri from (select distinct on (o_custkey) * from oc order by o_custkey, total desc, o_orderkey) order by total desc, o_orderkey limit 100 offset 2"),
    "W3_top_per_parent": (lambda s, d: o_cents(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("total"), "o_orderkey"))).filter("rn <= 2").select("o_custkey", "o_orderkey", "rn"), OC + "select o_custkey, o_orderkey, cast(rn as int) as rn from (select *, row_number() over (partition by o_custkey order by total desc, o_orderkey) as rn from oc) where rn <= 2"),
    "W4_rank_lag": (lambda s, d: (lambda w: o_cents(s, d).select("o_orderkey", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus")).alias("dr"), F.lag("o_orderkey").over(w).alias("prev"), F.sum("total").over(w.rowsBetween(-2, 0)).alias("s3")))(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")), OC + "select o_orderkey, cast(dense_rank() over (partition by o_custkey order by o_orderstatus) as int) as dr, lag(o_orderkey) over w as prev, cast(sum(total) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as bigint) as s3 from oc window w as (partition by o_custkey order by o_orderdate, o_orderkey)"),
    "L1_order_default_nulls": (paged(order_by=[("pri", "desc"), "total"], take=3500, select=COLS), OC + "select o_orderkey, total, pri from oc order by pri desc nulls first, total, o_orderkey limit 3500"),
    "L2_order_nulls_placed": (paged(order_by=[("pri", "asc", "first"), ("total", "desc")], take=3500, select=COLS), OC + "select o_orderkey, total, pri from oc order by pri asc nulls first, total desc, o_orderkey limit 3500"),
    "L3_order_by_parent": (lambda s, d: P.find_many(R.nest_one(o_cents(s, d), "o_custkey", table(s, d, "customer"), "c_custkey", "u", ["c_name"]).withColumn("c_name", F.col("u.c_name")), ["o_orderkey"], order_by=[("c_name", "desc")], take=40, select=["o_orderkey", "c_name"]), "select o_orderkey, c_name from orders left join customer on o_custkey = c_custkey order by c_name desc nulls first, o_orderkey limit 40"),
    "L4_order_by_count": (lambda s, d: P.find_many(R.relation_count(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey", "n"), ["c_custkey"], order_by=[("n", "desc")], take=25, select=["c_custkey", "n"]), "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1 order by n desc, c_custkey limit 25"),
    "L5_skip_take": (paged(order_by=["total"], skip=100, take=20, select=COLS), OC + "select o_orderkey, total, pri from oc order by total, o_orderkey limit 20 offset 100"),
    "L6_latest_job": (lambda s, d: P.latest_of(table(s, d, "events").select("user_id", F.col("event_id").alias("job"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), "user_id", "at", "r"), "select user_id, arg_max(event_id, ts) as job, epoch_us(max(ts)) as at from events group by 1"),
    "L7_negative_take": (paged(order_by=["total"], take=-15, select=COLS), OC + "select o_orderkey, total, pri from oc order by total desc, o_orderkey desc limit 15"),
    "L8_cursor": (paged(order_by=[("pri", "desc"), "total"], cursor={"o_orderkey": 77}, skip=1, take=30, select=COLS), OC + "select o_orderkey, total, pri from (select *, row_number() over (order by pri desc nulls first, total, o_orderkey) as rn from oc) where rn > (select rn from (select o_orderkey, row_number() over (order by pri desc nulls first, total, o_orderkey) as rn from oc) where o_orderkey = 77) order by rn limit 30"),
    "L8_cursor_missing": (paged(order_by=["total"], cursor={"o_orderkey": -1}, take=30, select=COLS), OC + "select o_orderkey, total, pri from oc where false"),
    "L8_cursor_back": (paged(order_by=["total"], cursor={"o_orderkey": 77}, take=-10, select=COLS), OC + "select o_orderkey, total, pri from (select *, row_number() over (order by total, o_orderkey) as rn from oc) where rn <= (select rn from (select o_orderkey, row_number() over (order by total, o_orderkey) as rn from oc) where o_orderkey = 77) order by rn desc limit 10"),
    "L11_stable_sort": (lambda s, d: P.stable_sort_prefix(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("stamp")), "stamp", "event_id", 50), "select event_id, case when event_id % 3 > 0 then user_id end as stamp from events order by coalesce(stamp, 0) desc, event_id limit 50"),
    # sets
    "U4_union_intersect_except": (lambda s, d: (lambda e: e.filter("event_type = 'click'").select("user_id").union(e.filter("event_type = 'view'").select("user_id")).distinct().intersect(e.filter("event_type = 'purchase'").select("user_id")).exceptAll(e.filter("event_type = 'error' and value > 95").select("user_id").distinct()))(table(s, d, "events")), "(select user_id from events where event_type in ('click', 'view') intersect select user_id from events where event_type = 'purchase') except select user_id from events where event_type = 'error' and value > 95"),
}
