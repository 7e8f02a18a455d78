"""Wallet, ledger, coupon and snapshot queries. Events stand in for credit movements, parts for coupons and packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scalars as X
from brindle.operators import ledger as E
from brindle.operators import paging as P
from brindle.operators import snapshots as M
from brindle.sources.tables import table

def as_of():
    return F.expr("timestamp_ntz'2024-01-15 00:00:00'")


def moves(s: SparkSession, d: str) -> DataFrame:
    """Signed credit movements: purchases and signups earn, views and clicks spend, errors move nothing."""
    v = X.cents(F.col("value"))
    t = F.col("event_type")
    amount = F.when(t.isin("purchase", "signup"), v).when(t.isin("view", "click"), -v).otherwise(0)
    return table(s, d, "events").select("event_id", "user_id", "event_type", "ts", amount.cast("bigint").alias("amount"))


MV = """mv as (select event_id, user_id, event_type, ts, cast(case when event_type in ('purchase', 'signup') then round(value * 100) when event_type in ('view', 'click') then -round(value * 100) else 0 end as bigint) as amount from events)"""


def wallets(s, d):
    m = moves(s, d)
    a = F.col("amount")
    return m.groupBy("user_id").agg(F.sum("amount").alias("balance"), F.sum(F.greatest(a, F.lit(0))).alias("lifetime_earned"), F.sum(F.greatest(-a, F.lit(0))).alias("lifetime_spent"))


WL = MV + """, wl as (select user_id, cast(sum(amount) as bigint) as balance, cast(sum(greatest(amount, 0)) as bigint) as lifetime_earned, cast(sum(greatest(-amount, 0)) as bigint) as lifetime_spent from mv group by 1)"""


def coupons(s, d):
    """A coupon of each part, built so that every rung is met."""
    k = F.col("p_partkey")
    none = lambda kind: F.lit(None).cast(kind)
    day = lambda n: (as_of() + F.make_dt_interval(F.lit(n))).cast("timestamp_ntz")
    return table(s, d, "part").select(
        k.alias("coupon_id"),
        X.normalise_code(F.concat(F.lit("  c-"), k.cast("string"), F.lit(" "))).alias("code"),
        F.when(k % 11 == 0, "DISABLED").otherwise("ACTIVE").alias("status"),
        F.when(k % 5 == 0, "CHECKOUT").otherwise("DIRECT_REDEEM").alias("redemption_type"),
        F.when(k % 7 == 0, none("int")).otherwise(F.col("p_size")).alias("credit_amount"),
        F.when(k % 3 == 0, none("int")).otherwise((k % 4 + 2).cast("int")).alias("max_uses"),
        (k % 4).cast("int").alias("used_count"),
        F.lit(2).alias("per_user_limit"),
        F.when(k % 13 == 0, day(1)).when(k % 13 == 1, day(0)).otherwise(none("timestamp_ntz")).alias("starts_at"),
        F.when(k % 17 == 0, day(-1)).when(k % 17 == 1, day(0)).otherwise(none("timestamp_ntz")).alias("expires_at"),
    )


CP = """cp as (select p_partkey as coupon_id, 'C-' || p_partkey as code, case when p_partkey % 11 = 0 then 'DISABLED' else 'ACTIVE' end as status, case when p_partkey % 5 = 0 then 'CHECKOUT' else 'DIRECT_REDEEM' end as redemption_type,
 case when p_partkey % 7 = 0 then null else p_size end as credit_amount, case when p_partkey % 3 = 0 then null else cast(p_partkey % 4 + 2 as int) end as max_uses, cast(p_partkey % 4 as int) as used_count, 2 as per_user_limit,
 case when p_partkey % 13 = 0 then timestamp '2024-01-16' when p_partkey % 13 = 1 then timestamp '2024-01-15' end as starts_at, case when p_partkey % 17 = 0 then timestamp '2024-01-14' when p_partkey % 17 = 1 then timestamp '2024-01-15' end as expires_at from part),
us as (select user_id, event_id % 200 + 1 as coupon_id from events where event_type = 'purchase')"""


def usages(s, d):
    return table(s, d, "events").filter("event_type = 'purchase'").select("user_id", (F.col("event_id") % 200 + 1).alias("coupon_id"))


def asked(s, d, user=7):
    """All coupons as one user asks for them, and three that don't exist."""
    c = E.with_usage(coupons(s, d), usages(s, d), F.lit(user))
    ids = table(s, d, "part").select(F.col("p_partkey").alias("asked")).unionByName(s.range(-3, 0).select(F.col("id").alias("asked")))
    return ids.join(c, F.col("asked") == F.col("coupon_id"), "left")


ASKED = "with " + CP + """, a as (select r.i as asked, cp.*, coalesce((select count(*) from us where us.coupon_id = cp.coupon_id and us.user_id = 7), 0) as used_by_user from (select p_partkey as i from part union all select unnest(range(-3, 0)) as i) r left join cp on cp.coupon_id = r.i) """


def attempts(s, d):
    e = table(s, d, "events").filter("event_type in ('click', 'view')")
    return e.select(F.col("event_id").alias("attempt_id"), "user_id", (F.col("event_id") % 40 + 1).alias("coupon_id"), F.col("ts").alias("at"))


def outcome(s, d):
    return E.redeem_log(attempts(s, d), coupons(s, d), usages(s, d))


OUT = "with " + CP + """, tr as (select event_id as attempt_id, user_id, event_id % 40 + 1 as coupon_id, ts as t from events where event_type in ('click', 'view')),
a1 as (select tr.attempt_id, tr.user_id, tr.coupon_id as cid, tr.t, cp.*, coalesce(u.n, 0) as used_by_user from tr left join cp on cp.coupon_id = tr.coupon_id left join (select user_id, coupon_id, count(*) as n from us group by 1, 2) u on u.user_id = tr.user_id and u.coupon_id = tr.coupon_id),
a2 as (select *, case when status is null then 'Invalid coupon' when status <> 'ACTIVE' then 'Coupon inactive' when redemption_type <> 'DIRECT_REDEEM' then 'Coupon requires checkout' when credit_amount is null then 'Coupon has no redeemable credits' when starts_at > t then 'Coupon not started' when expires_at < t then 'Coupon expired' end as early from a1),
a3 as (select *, early is null and sum(case when early is null then 1 else 0 end) over (partition by cid, user_id order by t, attempt_id) + used_by_user <= per_user_limit as within from a2),
a4 as (select *, used_count + coalesce(sum(case when within then 1 else 0 end) over (partition by cid order by t, attempt_id rows between unbounded preceding and 1 preceding), 0) as taken from a3),
o as (select attempt_id, user_id, cid as coupon_id, code, t, credit_amount, coalesce(early, case when max_uses is not null and taken >= max_uses then 'Coupon exhausted' when not within then 'Redemption limit reached' end) as reason from a4) """


def effect(name: str, *columns: str):
    return lambda s, d: E.redeem_effects(outcome(s, d), coupons(s, d), wallets(s, d))[name].select(*columns)


def packs(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") * 10).alias("credit_amount"), X.cents(F.col("p_retailprice")).alias("price"), (F.col("p_size") >= 25).alias("is_active"), F.col("p_size").alias("sort_order"))


PK = "pk as (select p_partkey as id, p_name as name, p_size * 10 as credit_amount, cast(round(p_retailprice * 100) as bigint) as price, p_size >= 25 as is_active, p_size as sort_order from part)"


def customers(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name", X.cents(F.col("c_acctbal")).alias("bal"), "c_mktsegment")


CU = "cu as (select c_custkey, c_name, cast(round(c_acctbal * 100) as bigint) as bal, c_mktsegment from customer) "


def new_customers(s, d):
    """Rows that partly collide with old ones and with each other."""
    return table(s, d, "supplier").select((F.col("s_suppkey") % 30 + 1485).alias("c_custkey"), F.concat(F.lit("New#"), (F.col("s_suppkey") % 35).cast("string")).alias("c_name"), F.lit(0).cast("bigint").alias("bal"), F.lit("NEW").alias("c_mktsegment"), F.col("s_suppkey").alias("pos"))


NC = ", nc as (select s_suppkey % 30 + 1485 as c_custkey, 'New#' || (s_suppkey % 35) as c_name, cast(0 as bigint) as bal, 'NEW' as c_mktsegment, s_suppkey as pos from supplier) "
KEYS = [["c_custkey"]]


def flagship_wallet(s, d):
    """Balance, earnings and newest movement of every user."""
    return moves(s, d).groupBy("user_id").agg(F.sum("amount").alias("balance"), F.count("*").alias("n"), F.sum(F.greatest("amount", F.lit(0))).alias("earned"), F.max("ts").alias("newest"))


QUERIES = {
    "flagship_wallet": (flagship_wallet, "with " + MV + " select user_id, cast(sum(amount) as bigint) as balance, count(*) as n, cast(sum(greatest(amount, 0)) as bigint) as earned, max(ts) as newest from mv group by 1"),
    "W1_running_balance": (lambda s, d: E.running_balance(moves(s, d), "user_id", "amount", "ts", "event_id").select("event_id", "balance_after"), "with " + MV + " select event_id, cast(sum(amount) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as balance_after from mv"),
    "W5_W6_redeem_log": (lambda s, d: outcome(s, d).select("attempt_id", "reason"), OUT + "select attempt_id, reason from o"),
    "E1_inspect_ladder": (lambda s, d: E.inspect(asked(s, d), as_of()).select("asked", "valid", "redeemable", "reason"), ASKED + """, r as (select *, case when status is null then 'No coupon found' when status <> 'ACTIVE' then 'Coupon inactive' when starts_at > timestamp '2024-01-15' then 'Coupon not started' when expires_at < timestamp '2024-01-15' then 'Coupon expired' when used_count >= max_uses then 'Coupon exhausted' end as bad from a)
select asked, bad is null as valid, bad is null and used_by_user < per_user_limit and redemption_type = 'DIRECT_REDEEM' and credit_amount is not null as redeemable, coalesce(bad, case when used_by_user >= per_user_limit then 'Redemption limit reached' end) as reason from r"""),
    "E2_redeem_ladder": (lambda s, d: asked(s, d).select("asked", E.redeem_reason(as_of()).alias("reason")), ASKED + "select asked, case when status is null then 'Invalid coupon' when status <> 'ACTIVE' then 'Coupon inactive' when redemption_type <> 'DIRECT_REDEEM' then 'Coupon requires checkout' when credit_amount is null then 'Coupon has no redeemable credits' when starts_at > timestamp '2024-01-15' then 'Coupon not started' when expires_at < timestamp '2024-01-15' then 'Coupon expired' when used_count >= max_uses then 'Coupon exhausted' when used_by_user >= per_user_limit then 'Redemption limit reached' end as reason from a"),
    "E3_usages": (effect("usages", "user_id", "coupon_id", "credits_granted", "created_at"), OUT + "select user_id, coupon_id, credit_amount as credits_granted, t as created_at from o where reason is null"),
    "E3_ledger": (effect("ledger", "attempt_id", "type", "amount", "balance_after", "description", "source"), OUT.replace("with cp", "with " + WL + ", cp", 1) + "select attempt_id, 'COUPON' as type, credit_amount as amount, cast(coalesce(balance, 0) + sum(credit_amount) over (partition by o.user_id order by t, attempt_id rows unbounded preceding) as bigint) as balance_after, 'Redeemed ' || code as description, 'COUPON_REDEMPTION' as source from o left join wl on wl.user_id = o.user_id where reason is null"),
    "E3_wallets": (effect("wallets", "user_id", "balance", "lifetime_earned"), OUT.replace("with cp", "with " + WL + ", cp", 1) + "select coalesce(wl.user_id, g.user_id) as user_id, cast(coalesce(balance, 0) + coalesce(x, 0) as bigint) as balance, cast(coalesce(lifetime_earned, 0) + coalesce(x, 0) as bigint) as lifetime_earned from wl full join (select user_id, sum(credit_amount) as x from o where reason is null group by 1) g on g.user_id = wl.user_id"),
    "E3_coupons": (effect("coupons", "coupon_id", "used_count"), OUT + "select cp.coupon_id, cast(used_count + coalesce(n, 0) as bigint) as used_count from cp left join (select coupon_id, count(*) as n from o where reason is null group by 1) x on x.coupon_id = cp.coupon_id"),
    "E4_preview": (lambda s, d: E.inspect(asked(s, d), as_of()).filter("valid").select("asked", "remaining_uses", "per_user_remaining", "credits_preview"), ASKED + "select asked, greatest(0, max_uses - used_count) + (max_uses - max_uses) as remaining_uses, greatest(0, per_user_limit - used_by_user) as per_user_remaining, credit_amount as credits_preview from a where status = 'ACTIVE' and not coalesce(starts_at > timestamp '2024-01-15', false) and not coalesce(expires_at < timestamp '2024-01-15', false) and not coalesce(used_count >= max_uses, false)"),
    "E5_active_catalogue": (lambda s, d: P.find_many(packs(s, d), ["id"], filter={"is_active": True}, order_by=["sort_order"], select=["id", "name", "credit_amount", "price"]), "with " + PK + " select id, name, credit_amount, price from pk where is_active"),
    "E6_active_item": (lambda s, d: P.find_first(packs(s, d), ["id"], filter={"id": {"in": [3, 4, 5, 6, 7, 8, 9]}, "is_active": True}, order_by=["sort_order"], select=["id", "name"]), "with " + PK + " select id, name from pk where id in (3, 4, 5, 6, 7, 8, 9) and is_active order by sort_order, id limit 1"),
    "E7_recent_ledger": (lambda s, d: P.find_many(table(s, d, "events"), ["event_id"], filter={"user_id": 7}, order_by=[("ts", "desc")], take=20, select=["event_id", "user_id", "event_type", "ts"]), "select event_id, user_id, event_type, ts from events where user_id = 7 order by ts desc, event_id limit 20"),
    "E8_wallet_summary": (lambda s, d: E.wallet_summary(table(s, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", wallets(s, d), "user_id", ["balance", "lifetime_earned", "lifetime_spent"]), "with " + WL + " select u.user_id, coalesce(balance, 0) as balance, coalesce(lifetime_earned, 0) as lifetime_earned, coalesce(lifetime_spent, 0) as lifetime_spent from (select c_custkey as user_id from customer) u left join wl on wl.user_id = u.user_id"),
    "E9_latest_job": (
        lambda s, d: P.latest_of(table(s, d, "events").select("user_id", F.col("event_id").alias("job"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp")), "user_id", "stamp", "r").select("user_id", "job", F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("in_progress").alias("status")),
        "select user_id, arg_max(event_id, ts) as job, case arg_max(event_type, ts) when 'purchase' then 'completed' when 'error' then 'failed' else 'in_progress' end as status from events group by 1",
    ),
    "E10_discount": (lambda s, d: table(s, d, "orders").select("o_orderkey", E.discounted(X.cents(F.col("o_totalprice")), F.when(F.col("o_orderkey") % 2 == 0, 15), F.when(F.col("o_orderkey") % 3 == 0, F.lit(5_000_000)), F.lit(10_000_000)).alias("due")), "with t as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as total from orders) select o_orderkey, cast(greatest(0, total - case when total >= 10000000 then coalesce(case when o_orderkey % 2 = 0 then total * 15 // 100 end, case when o_orderkey % 3 = 0 then 5000000 end, 0) else 0 end) as bigint) as due from t"),
    "E11_reserved": (lambda s, d: E.running_balance(moves(s, d).withColumn("held", F.when(F.col("event_type") == "click", -F.col("amount")).when(F.col("event_type") == "view", F.col("amount")).otherwise(0)), "user_id", "amount", "ts", "event_id", "held").select("event_id", "balance_after", "reserved_after"), "with " + MV + " select event_id, cast(sum(amount) over w as bigint) as balance_after, cast(sum(case event_type when 'click' then -amount when 'view' then amount else 0 end) over w as bigint) as reserved_after from mv window w as (partition by user_id order by ts, event_id rows unbounded preceding)"),
    # snapshots
    "M1_create": (lambda s, d: M.create(customers(s, d), {"c_custkey": 999_999, "c_name": "One"}).rows, "with " + CU + "select * from cu union all select 999999, 'One', null, null"),
    "M2_create_many": (lambda s, d: M.create_many(customers(s, d), new_customers(s, d)).rows, "with " + CU + NC + "select * from cu union all select c_custkey, c_name, bal, c_mktsegment from nc"),
    "U3_skip_duplicates": (lambda s, d: M.create_many(customers(s, d), new_customers(s, d), [["c_custkey"], ["c_name"]], True, "pos").changed, "with " + CU + NC + ", k1 as (select * from (select *, row_number() over (partition by c_custkey order by pos) as r from nc where c_custkey not in (select c_custkey from cu)) where r = 1), k2 as (select *, row_number() over (partition by c_name order by pos) as q from k1 where c_name not in (select c_name from cu)) select c_custkey, c_name, bal, c_mktsegment from k2 where q = 1"),
    "M4_update": (lambda s, d: M.update(customers(s, d), KEYS, {"c_custkey": 12}, {"bal": M.increment("bal", 500)}).rows, "with " + CU + "select c_custkey, c_name, bal + case when c_custkey = 12 then 500 else 0 end as bal, c_mktsegment from cu"),
    "M5_update_many_limit": (lambda s, d: M.update_many(customers(s, d), {"c_mktsegment": "BUILDING"}, {"c_mktsegment": "BUILT"}, 50, [("bal", "desc")], ["c_custkey"]).rows, "with " + CU + ", t as (select c_custkey from cu where c_mktsegment = 'BUILDING' order by bal desc, c_custkey limit 50) select c_custkey, c_name, bal, case when c_custkey in (select c_custkey from t) then 'BUILT' else c_mktsegment end as c_mktsegment from cu"),
    "M6_update_returning": (lambda s, d: M.update_many(customers(s, d), {"bal": {"lt": 0}}, {"bal": M.multiply("bal", 2)}).changed, "with " + CU + "select c_custkey, c_name, bal * 2 as bal, c_mktsegment from cu where bal < 0"),
    "M7_upsert": (lambda s, d: M.upsert(customers(s, d), new_customers(s, d).groupBy("c_custkey").agg(F.min("c_name").alias("c_name"), F.count("*").alias("bal"), F.max("c_mktsegment").alias("c_mktsegment")), ["c_custkey"], {"bal": F.col("bal") + F.col("new_bal")}).rows, "with " + CU + NC + ", i as (select c_custkey, min(c_name) as c_name, count(*) as bal, max(c_mktsegment) as c_mktsegment from nc group by 1) select coalesce(cu.c_custkey, i.c_custkey) as c_custkey, case when cu.c_custkey is null then i.c_name else cu.c_name end as c_name, case when cu.c_custkey is null then i.bal else cu.bal + coalesce(i.bal, 0) end as bal, case when cu.c_custkey is null then i.c_mktsegment else cu.c_mktsegment end as c_mktsegment from cu full join i on i.c_custkey = cu.c_custkey"),
    "M8_delete_many": (lambda s, d: M.delete_many(customers(s, d), {"bal": {"lt": 0}}).rows, "with " + CU + "select * from cu where not bal < 0"),
    "M8_delete_limit_count": (lambda s, d: M.delete_many(customers(s, d), {"bal": {"lt": 0}}, 20, ["bal"], ["c_custkey"]).count(), "with " + CU + "select least(20, count(*)) as count from cu where bal < 0"),
    "M9_number_operators": (lambda s, d: customers(s, d).select("c_custkey", M.increment("bal", 7).alias("up"), M.decrement("bal", 7).alias("down"), M.multiply("bal", 3).alias("times"), M.divide("bal", 7).alias("part")), "with " + CU + "select c_custkey, bal + 7 as up, bal - 7 as down, bal * 3 as times, bal // 7 as part from cu"),
    "M10_array_push": (lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f")).select("l_orderkey", F.array_join(M.push("f", "X", "Y"), "").alias("f")), "select l_orderkey, string_agg(distinct l_returnflag, '' order by l_returnflag) || 'XY' as f from lineitem group by 1"),
    "M12_connect_disconnect": (lambda s, d: M.disconnect(M.connect(table(s, d, "orders").select("o_orderkey", "o_custkey"), {"o_orderkey": {"lt": 10}}, "o_custkey", 1).rows, {"o_orderkey": {"gt": 14_900}}, "o_custkey").rows, "select o_orderkey, case when o_orderkey < 10 then 1 when o_orderkey > 14900 then null else o_custkey end as o_custkey from orders"),
    "M14_cascade": (lambda s, d: M.cascade(M.delete_many(customers(s, d), {"bal": {"lt": 0}}).changed, "c_custkey", table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey"), "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where round(c_acctbal * 100) < 0)"),
    # scalars
    "X1_normalise": (lambda s, d: table(s, d, "customer").select("c_custkey", X.normalise_code(F.concat(F.lit(" \t "), F.lower("c_mktsegment"), F.lit("﻿ "))).alias("code")), "select c_custkey, upper(c_mktsegment) as code from customer"),
    "X2_length": (lambda s, d: table(s, d, "documents").select("doc_id", X.length_between(F.col("text"), 3, 1000).alias("ok")), "select doc_id, length(text) between 3 and 1000 as ok from documents"),
    "X3_url_host": (lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), X.looks_like_email(F.col("url")).alias("email")), r"select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, false as email from pages"),
    "X3_email": (lambda s, d: table(s, d, "documents").select("doc_id", F.regexp_extract("text", r"[^ \n]+@[^ \n]+", 0).alias("address")).filter("address <> ''").select("doc_id", "address", X.looks_like_email(F.col("address")).alias("email")), r"with a as (select doc_id, regexp_extract(text, '[^ \n]+@[^ \n]+') as address from documents) select doc_id, address, regexp_matches(address, '^[A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') as email from a where address <> ''"),
    "X4_minor_units": (lambda s, d: customers(s, d).select("c_custkey", X.minor_units(F.col("bal")).alias("shown")), "with " + CU + "select c_custkey, case when bal < 0 then '-' else '' end || '$' || format('{:,.2f}', abs(bal) / 100) as shown from cu"),
    "X6_at_least_zero": (lambda s, d: table(s, d, "orders").select("o_orderkey", X.at_least_zero(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") - 700)).alias("n")), "select o_orderkey, case when o_orderkey % 5 > 0 then greatest(0, o_custkey - 700) end as n from orders"),
    "X8_open_ends": (lambda s, d: coupons(s, d).select("coupon_id", (X.started(F.col("starts_at"), as_of()) & X.not_ended(F.col("expires_at"), as_of())).alias("live")), "with " + CP + " select coupon_id, (starts_at is null or starts_at <= timestamp '2024-01-15') and (expires_at is null or expires_at >= timestamp '2024-01-15') as live from cp"),
    "X10_X11_texts": (lambda s, d: table(s, d, "events").select("event_id", F.replace(F.coalesce(F.when(F.col("event_type") == "error", "bad string value"), F.lit("Unknown Error")), F.lit("string"), F.lit("field")).alias("msg")), "select event_id, case when event_type = 'error' then 'bad field value' else 'Unknown Error' end as msg from events"),
    "X12_json_round_trip": (lambda s, d: table(s, d, "events").select("event_id", F.from_json(F.to_json(F.struct("event_type", "user_id")), "event_type string, user_id bigint").alias("j")).select("event_id", "j.event_type", "j.user_id"), "select event_id, event_type, user_id from events"),
    "X14_int_or_zero": (lambda s, d: table(s, d, "orders").select("o_orderkey", (X.int_or_zero(F.substring("o_orderpriority", 1, 1)) + X.int_or_zero(F.col("o_orderstatus"))).alias("n")), "select o_orderkey, coalesce(try_cast(substr(o_orderpriority, 1, 1) as int), 0) + coalesce(try_cast(o_orderstatus as int), 0) as n from orders"),
    "X15_keys": (lambda s, d: table(s, d, "events").select("event_id", F.concat(F.lit("job:"), F.col("event_id").cast("string"), F.lit(":progress")).alias("k")), "select event_id, 'job:' || event_id || ':progress' as k from events"),
    "X16_X17_initial": (lambda s, d: table(s, d, "customer").select("c_custkey", X.initial(F.when(F.col("c_custkey") % 4 > 0, F.lower("c_mktsegment")).when(F.col("c_custkey") % 8 > 0, "")).alias("i"), F.col("c_name").startswith("Customer").alias("p")), "select c_custkey, case when c_custkey % 4 > 0 then upper(c_mktsegment[1]) else 'U' end as i, starts_with(c_name, 'Customer') as p from customer"),
}
