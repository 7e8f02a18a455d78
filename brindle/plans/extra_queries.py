"""Remaining forms: returning mutations, snapshots of progress, reuse of results, ranking and approximate aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.predicates import where
from brindle.operators import snapshots as M
from brindle.operators import signals as S
from brindle.operators.windows import carried_before
from brindle.plans.ledger_queries import CU, MV, NC, customers, moves, new_customers
from brindle.plans.stream_queries import PR, progress
from brindle.sources.tables import table
from brindle.streaming import progress as T


def reuse(s: SparkSession, d: str) -> DataFrame:
    """A job may reuse the newest result of its topic within five days, at 5 credits; otherwise it costs 50."""
    e = table(s, d, "events").withColumn("topic", F.get_json_object("props", "$.k"))
    e = carried_before(e, ["topic"], ["ts", "event_id"], None, F.when(F.col("event_type") == "purchase", F.struct("event_id", "ts")), "p", last=True)
    near = F.col("p.ts") >= F.col("ts") - F.expr("interval 5 days")
    return e.select("event_id", F.when(near, F.col("p.event_id")).alias("reused"), F.when(near, 5).otherwise(50).alias("credits"))


def iteration_gate(s: SparkSession, d: str, least: int = 3, threshold: int = 40) -> DataFrame:
    """Rounds of signals by source number until at least ``least`` languages have ``threshold`` signals: the round each
    language passes in, cumulated in one pass."""
    docs = table(s, d, "documents").withColumn("round", F.regexp_extract("source", r"(\d+)", 1).cast("int"))
    per = docs.groupBy("lang", "round").agg(F.count("*").alias("n"))
    cum = per.withColumn("seen", F.sum("n").over(Window.partitionBy("lang").orderBy("round")))
    passed = cum.filter(F.col("seen") >= threshold).groupBy("lang").agg(F.min("round").alias("passed_in"))
    rank = F.row_number().over(Window.orderBy("passed_in", "lang"))  # one row per language
    return passed.withColumn("rank", rank).filter(F.col("rank") <= least).select("lang", "passed_in")


def top_words(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "documents").select("lang", F.explode(F.split(F.lower("text"), "[ \n]+")).alias("w"))
    n = w.groupBy("lang", "w").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).filter("r <= 5").select("lang", "w", "n")


QUERIES = {
    "P3_renamed_cast": (lambda s, d: table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("string").alias("currency")), "select cast(p_partkey as varchar) as id, cast(p_size as varchar) as currency from part"),
    "F24_filter_rows": (lambda s, d: table(s, d, "events").filter(where({"user_id": {"in": [3, 5, 8]}, "event_type": {"not": "view"}})).select("event_id"), "select event_id from events where user_id in (3, 5, 8) and event_type <> 'view'"),
    "J10_left_lookup": (lambda s, d: table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select(F.col("doc_id").alias("l"), "quality"), F.col("doc_id") == F.col("l"), "left").select("doc_id", "quality"), "select d.doc_id, quality from documents d left join labels l on l.doc_id = d.doc_id"),
    "J12_dimension_join": (lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n")), "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1"),
    "A12_affected_count": (lambda s, d: M.update_many(customers(s, d), {"bal": {"gt": 500_000}}, {"c_mktsegment": "RICH"}).count(), "with " + CU + "select count(*) as count from cu where bal > 500000"),
    "A17_spread": (lambda s, d: moves(s, d).groupBy("event_type").agg(F.round(F.stddev_samp("amount"), 2).alias("sd"), F.percentile("amount", F.lit(0.5)).alias("med"), F.max("amount").alias("top")), "with " + MV + " select event_type, round(stddev_samp(amount), 2) as sd, quantile_cont(amount, 0.5) as med, max(amount) as top from mv group by 1"),
    "A18_grouping_sets": (lambda s, d: s.sql("select l_returnflag, l_linestatus, count(*) as n from {li} group by grouping sets ((l_returnflag), (l_linestatus), ())", li=table(s, d, "lineitem")), "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())"),
    "W4_ntile_first_last": (lambda s, d: (lambda w: moves(s, d).select("event_id", F.ntile(4).over(w).alias("q"), F.first("event_type").over(w).alias("f"), F.last("event_type").over(w.rowsBetween(-1, 1)).alias("l")))(Window.partitionBy("user_id").orderBy("ts", "event_id")), "with " + MV + " select event_id, cast(ntile(4) over w as int) as q, first_value(event_type) over w as f, last_value(event_type) over (partition by user_id order by ts, event_id rows between 1 preceding and 1 following) as l from mv window w as (partition by user_id order by ts, event_id)"),
    "W4_range_frame": (lambda s, d: moves(s, d).select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)).alias("n")), "select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row) as n from events"),
    "L10_delete_cap": (lambda s, d: M.delete_many(customers(s, d), {"c_mktsegment": "BUILDING"}, 30, [("bal", "desc")], ["c_custkey"]).rows.select("c_custkey"), "with " + CU + "select c_custkey from cu where c_custkey not in (select c_custkey from cu where c_mktsegment = 'BUILDING' order by bal desc, c_custkey limit 30)"),
    "M3_insert_returning": (lambda s, d: M.create_many(customers(s, d), new_customers(s, d)).changed, "with " + CU + NC + "select c_custkey, c_name, bal, c_mktsegment from nc"),
    "M11_set_values": (lambda s, d: M.update_many(customers(s, d), {"c_custkey": {"lte": 5}}, {"c_name": "x", "bal": None}).rows, "with " + CU + "select c_custkey, case when c_custkey <= 5 then 'x' else c_name end as c_name, case when c_custkey <= 5 then null else bal end as bal, c_mktsegment from cu"),
    "T5_latest_progress": (lambda s, d: progress(s, d).groupBy("job_id").agg(F.max_by("stage", "seq").alias("stage"), F.max("seq").alias("seq")), "with " + PR + " select job_id, arg_max(stage, seq) as stage, max(seq) as seq from pr group by 1"),
    "T6_emitted_stages": (lambda s, d: table(s, d, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("job_id"), F.posexplode(F.array(*[F.lit(x) for x in T.EMITTED])).alias("seq", "stage")), "select event_id as job_id, cast(i as int) as seq, ['confirmed', 'thinking', 'researching', 'evaluating', 'stitching', 'done'][i + 1] as stage from events, unnest(range(6)) t(i) where event_type = 'signup'"),
    "T13_iteration_gate": (iteration_gate, r"with p as (select lang, cast(regexp_extract(source, '(\d+)', 1) as int) as round, count(*) as n from documents group by 1, 2), c as (select lang, round, sum(n) over (partition by lang order by round) as seen from p), f as (select lang, min(round) as passed_in from c where seen >= 40 group by 1) select lang, passed_in from f order by passed_in, lang limit 3"),
    "E12_reuse": (reuse, "with e as (select event_id, ts, event_type, props->>'$.k' as topic from events), p as (select e.*, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over w as pid, last_value(case when event_type = 'purchase' then ts end ignore nulls) over w as pts from e window w as (partition by topic order by ts, event_id rows between unbounded preceding and 1 preceding)) select event_id, case when pts >= ts - interval 5 day then pid end as reused, case when pts >= ts - interval 5 day then 5 else 50 end as credits from p"),
    "X5_X20_dates": (lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m"), F.datediff(F.lit("1998-12-01").cast("date"), F.col("o_orderdate").cast("date")).cast("bigint").alias("age"), F.ceil(F.col("o_totalprice") / 1000).cast("bigint").alias("k")), "select o_orderkey, cast(date_trunc('month', o_orderdate) as timestamp) as m, cast(date_diff('day', o_orderdate::date, date '1998-12-01') as bigint) as age, cast(ceil(o_totalprice / 1000) as bigint) as k from orders"),
    "Y1_transform_hook": (lambda s, d: table(s, d, "part").transform(lambda df: df.filter("p_size > 45")).transform(lambda df: df.groupBy("p_brand").agg(F.count("*").alias("n"))), "select p_brand, count(*) as n from part where p_size > 45 group by 1"),
    "E16_top_words": (top_words, r"with n as (select lang, w, count(*) as n from (select lang, unnest(regexp_split_to_array(lower(text), '[ \n]+')) as w from documents) group by 1, 2) select lang, w, n from (select *, row_number() over (partition by lang order by n desc, w) as r from n) where r <= 5"),
    "U2_url_dedup": (lambda s, d: S.first_of_url(table(s, d, "pages"), "url", "page_id").select("page_id", "address", "n"), r"with p as (select page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') as u from pages) select min(page_id) as page_id, case when u like '%://%' then lower(regexp_extract(u, '^[^/?]*://[^/?]*')) || substr(u, length(regexp_extract(u, '^[^/?]*://[^/?]*')) + 1) else u end as address, count(*) as n from p group by 2"),
    "E15_label_centres": (lambda s, d: S.centres(table(s, d, "embeddings"), "embedding", "label").select("label", "i", F.round("m", 9).alias("m"), "n"), "select label, cast(i - 1 as int) as i, round(avg(embedding[i]::double), 9) as m, count(*) as n from embeddings, unnest(range(1, len(embedding) + 1)) t(i) group by 1, 2"),
}
