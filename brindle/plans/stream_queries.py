"""Progress, key/value and signal queries. Events stand in for progress messages, documents for signals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import signals as S
from brindle.session import shared_dir
from brindle.sources.tables import SCHEMAS, table
from brindle.streaming import progress as T

STAGE = {"signup": "thinking", "view": "researching", "click": "evaluating", "purchase": "done", "error": "error"}
PRIORITY = {"src0": 1, "src1": 1, "src2": 2}
DEMAND = {"the": ["the "], "der": ["der "], "mit": ["license"]}
STRONG = ["idiot", "moron", "trash", "clown"]


def progress_of(e: DataFrame, *more: Column) -> DataFrame:
    """Every user's events as a job's progress; purchases of one value in a hundred end it, the rest count as stitching."""
    ends = F.col("event_id") % 40 == 0
    t = F.col("event_type")
    stage = F.when(t == "signup", "thinking").when(t == "view", "researching").when(t == "click", "evaluating").when(t == "purchase", F.when(ends, "done").otherwise("stitching")).otherwise(F.when(ends, "error").otherwise("confirmed"))
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), stage.alias("stage"), F.when(t == "view", F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("result"), F.when(stage == "error", "failed").alias("error"), *more)


PR = """pr as (select user_id as job_id, event_id as seq, case event_type when 'signup' then 'thinking' when 'view' then 'researching' when 'click' then 'evaluating' when 'purchase' then case when event_id % 40 = 0 then 'done' else 'stitching' end else case when event_id % 40 = 0 then 'error' else 'confirmed' end end as stage, case when event_type = 'view' then 'r' || event_id end as result, case when event_type = 'error' and event_id % 40 = 0 then 'failed' end as error from events),
lv as (select * from pr where seq <= coalesce((select min(seq) from pr q where q.job_id = pr.job_id and q.stage in ('done', 'error')), 1e18))"""


def progress(s: SparkSession, d: str) -> DataFrame:
    return progress_of(table(s, d, "events"))


def messages(s, d):
    body = F.when(F.col("seq") % 9 == 0, "{not json").otherwise(F.to_json(F.struct("stage", "result")))
    return progress(s, d).select("job_id", "seq", body.alias("message"))


def _run_stream(df: DataFrame, mode: str) -> DataFrame:
    """All available rows of a stream, written batch by batch below spark.checkpoint.dir and read again."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(f"{root}/rows/none")  # for a stream without batches

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/{n}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/rows/*")


def stream_fold(s, d):
    """The stream gives a row per job and micro-batch: the last of each job is its state."""
    out = _run_stream(T.fold_stream(progress_of(T.read_jobs(s, d, SCHEMAS["events"], "events.parquet"))), "update")
    return out.groupBy("job_id").agg(F.max_by(F.struct("stage", "result", "error", "events"), "events").alias("r")).select("job_id", "r.*")


def stream_windows(s, d):
    out = _run_stream(T.windowed_counts(T.read_jobs(s, d, SCHEMAS["events"], "events.parquet")), "update")
    return out.groupBy("start", "event_type").agg(F.max("n").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def store(s, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(s, d, "events").select(F.concat(F.lit("wallet:"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), micros.alias("at"), (micros + F.lit(5_000_000_000)).alias("expires_at"))


KV = "kv as (select 'wallet:' || user_id as key, event_type as value, epoch_us(ts) as set_at, epoch_us(ts) + 5000000000 as expires_at from events)"
NOW = 1_706_500_000_000_000


def pre(s, d):
    return S.preprocess(table(s, d, "documents"), table(s, d, "labels"), PRIORITY, DEMAND, STRONG)


PRE = r"""h as (select doc_id, text, source, lang, sha256(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'), ' ')) as content_hash from documents),
pre as (select h.doc_id, source, lang, case source when 'src0' then 1 when 'src1' then 1 when 'src2' then 2 else 3 end as priority, (case when contains(lower(text), 'idiot') then 1 else 0 end + case when contains(lower(text), 'moron') then 1 else 0 end + case when contains(lower(text), 'trash') then 1 else 0 end + case when contains(lower(text), 'clown') then 1 else 0 end) / 4 as intensity,
 concat_ws(',', case when contains(lower(text), 'the ') then 'the' end, case when contains(lower(text), 'der ') then 'der' end, case when contains(lower(text), 'license') then 'mit' end) as demand_tags, content_hash
 from h left join labels l on l.doc_id = h.doc_id where (quality is null or quality = 1) and h.doc_id = (select min(doc_id) from h g where g.content_hash = h.content_hash))"""


def scored(s, d):
    c = S.rollup(pre(s, d), "source")
    c = c.withColumn("problem", F.least(F.lit(1.0), F.col("intensity") * 20)).withColumn("market", F.least(F.lit(1.0), F.col("frequency") / 50)).withColumn("timing", F.size("affected") / 4)
    return S.score(c)


def clusters(s, d):
    return S.kmeans(table(s, d, "embeddings"), "embedding").select("vec_id", "cluster")


QUERIES = {
    "T1_stage_fold": (lambda s, d: T.fold(progress(s, d)), "with " + PR + " select job_id, arg_max(stage, seq) as stage, arg_max(result, seq) filter (result is not null) as result, arg_max(error, seq) filter (error is not null) as error, count(*) as events from lv group by 1"),
    "T1_stream_fold": (stream_fold, "with " + PR + " select job_id, arg_max(stage, seq) as stage, arg_max(result, seq) filter (result is not null) as result, arg_max(error, seq) filter (error is not null) as error, count(*) as events from lv group by 1"),
    "T2_until_terminal": (lambda s, d: T.until_terminal(progress(s, d)).select("job_id", "seq"), "with " + PR + " select job_id, seq from lv"),
    "T3_carry_forward": (lambda s, d: T.carried(progress(s, d)).select("seq", "result"), "with " + PR + " select seq, last_value(result ignore nulls) over (partition by job_id order by seq rows unbounded preceding) as result from pr"),
    "T4_malformed": (lambda s, d: T.parse(messages(s, d)), "with " + PR + " select job_id, seq, case when seq % 9 = 0 then 'error' else stage end as stage, case when seq % 9 = 0 then null else result end as result, case when seq % 9 = 0 then 'Invalid message' end as error from pr"),
    "T6_funnel": (lambda s, d: T.funnel(T.fold(progress(s, d))), "with " + PR + ", f as (select job_id, arg_max(stage, seq) as stage from lv group by 1), n as (select job_id, list_position(['idle', 'processing', 'confirmed', 'thinking', 'researching', 'evaluating', 'stitching', 'done'], stage) as p from f where stage <> 'error') select x.stage, count(*) as n from n join (values ('confirmed', 3), ('thinking', 4), ('researching', 5), ('evaluating', 6), ('stitching', 7), ('done', 8)) x(stage, p) on n.p >= x.p group by 1"),
    "T7_retry_delays": (lambda s, d: T.retry_delays(table(s, d, "events").select("event_id", (F.col("event_id") % 4 + 1).alias("attempt"))), "select event_id, event_id % 4 + 1 as attempt, cast(case event_id % 4 when 0 then 0 when 1 then 2000 else 4000 end as bigint) as delay_ms from events where event_id % 4 < 3"),
    "T10_first_source": (lambda s, d: (lambda p: T.first_of(T.fold(p), p.filter("stage = 'researching'").groupBy("job_id").agg(F.max("result").alias("result"))))(progress(s, d)), "with " + PR + ", a as (select job_id, arg_max(result, seq) filter (result is not null) as result from lv group by 1), b as (select job_id, max(result) as result from pr where stage = 'researching' group by 1) select coalesce(a.job_id, b.job_id) as job_id, coalesce(a.result, b.result) as result, case when a.result is not null then 0 else 1 end as source from a full join b on a.job_id = b.job_id where coalesce(a.result, b.result) is not null"),
    "T11_debounce": (lambda s, d: T.debounced(table(s, d, "events"), "user_id", "ts", "event_id", 3_600_000).select("event_id"), "select event_id from (select event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as nx from events) where nx is null or epoch_us(nx) - epoch_us(ts) >= 3600000000"),
    "T12_suppress_repeats": (lambda s, d: T.without_repeats(table(s, d, "events"), "user_id", "event_type", "event_id").select("event_id"), "select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as p from events) where p is distinct from event_type"),
    "T14_session_windows": (lambda s, d: table(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n"), "with g as (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval 6 hour then 0 else 1 end as b from events), i as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from i group by user_id, k"),
    "T14_stream_windows": (stream_windows, "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n from events group by 1, 2"),
    "S17_event_text": (lambda s, d: T.sse(progress(s, d)).select("seq", "text"), "with " + PR + """ select seq, 'id: ' || seq || chr(10) || 'data: {"stage":"' || stage || '"' || case when result is not null then ',"result":"' || result || '"' else '' end || case when error is not null then ',"error":"' || error || '"' else '' end || '}' || chr(10) || chr(10) as text from pr"""),
    "S18_kv_live": (lambda s, d: T.kv_live(store(s, d), NOW), "with " + KV + f" select key, arg_max(value, set_at) as value, arg_max(expires_at, set_at) as expires_at from kv group by 1 having not arg_max(expires_at, set_at) < {NOW}"),
    "S19_kv_set": (lambda s, d: T.kv_live(T.kv_set(store(s, d), "wallet:7", "fresh", NOW * 2, 9), NOW).filter("key = 'wallet:7'").select("key", "value"), "select 'wallet:7' as key, 'fresh' as value"),
    "S20_kv_delete": (lambda s, d: T.kv_delete(store(s, d), table(s, d, "events").filter("user_id < 100").select(F.concat(F.lit("wallet:"), F.col("user_id").cast("string")).alias("key"))).groupBy("key").agg(F.count("*").alias("n")), "with " + KV + " select key, count(*) as n from kv where cast(substr(key, 8) as int) >= 100 group by 1"),
    "S22_result_source": (lambda s, d: T.fold(progress(s, d)).join(progress(s, d).filter("stage = 'done'").select(F.col("job_id").alias("j"), F.col("seq").alias("done_at")), F.col("job_id") == F.col("j"), "left").groupBy("job_id").agg(F.min("done_at").alias("done_at")), "with " + PR + " select job_id, min(seq) filter (stage = 'done') as done_at from pr group by 1"),
    "S23_sources": (lambda s, d: table(s, d, "documents").select("source", F.lit(1).alias("priority")).unionByName(table(s, d, "pages").select(F.lit("web").alias("source"), F.lit(2).alias("priority"))).groupBy("source", "priority").agg(F.count("*").alias("n")), "select source, 1 as priority, count(*) as n from documents group by 1 union all select 'web', 2, count(*) from pages"),
    "U1_merge_new": (lambda s, d: (lambda h: S.merge_new(h.filter("doc_id % 2 = 0"), h.filter("doc_id % 2 = 1").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content_hash")))(table(s, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("content_hash"))), "with " + PRE + " select doc_id, content_hash from h where doc_id % 2 = 0 union all select min(doc_id), content_hash from h where doc_id % 2 = 1 and content_hash not in (select content_hash from h where doc_id % 2 = 0) group by content_hash"),
    "U2_dedup_hash": (lambda s, d: S.dedupe(table(s, d, "documents")).select("doc_id", "content_hash"), "with " + PRE + " select min(doc_id) as doc_id, content_hash from h group by 2"),
    "X18_content_hash": (lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "select doc_id, sha256(text) as h from documents"),
    "E13_topic_queries": (lambda s, d: S.queries_for(table(s, d, "region").select(F.col("r_name").alias("topic"))), "select r_name as topic, i as intent, r_name || ' ' || lower(replace(i, '_', ' ')) as query from region, unnest(['COMPLAINT', 'WORKAROUND', 'DEMAND', 'COMPETITOR', 'FAILURE_POST', 'FEATURE_REQUEST']) t(i)"),
    "E14_preprocess": (lambda s, d: pre(s, d).withColumn("demand_tags", F.array_join("demand_tags", ",")), "with " + PRE + " select * from pre"),
    "A15_cluster_rollup": (lambda s, d: S.rollup(pre(s, d), "source").select("source", "frequency", F.round("intensity", 9).alias("intensity"), F.array_join("affected", ",").alias("affected")), "with " + PRE + " select source, count(*) as frequency, round(avg(intensity), 9) as intensity, string_agg(distinct lang, ',' order by lang) as affected from pre group by 1"),
    "A16_score": (lambda s, d: scored(s, d).select("source", F.round("final", 6).alias("final"), "quadrant"), "with " + PRE + ", c as (select source, least(1.0::double, avg(intensity) * 20) as problem, least(1.0::double, count(*)::double / 50) as market, count(distinct lang)::double / 4 as timing from pre group by 1) select source, round(0.5 * problem + 0.3 * market + 0.2 * timing, 6) as final, case when problem >= 0.5 then 'strong' else 'weak' end || '/' || case when market >= 0.5 then 'large' else 'small' end as quadrant from c"),
    "L12_top_clusters": (lambda s, d: scored(s, d).orderBy(F.round("final", 9).desc(), "source").limit(3).select("source"), "with " + PRE + ", c as (select source, least(1.0::double, avg(intensity) * 20) as problem, least(1.0::double, count(*)::double / 50) as market, count(distinct lang)::double / 4 as timing from pre group by 1) select source from c order by round(0.5 * problem + 0.3 * market + 0.2 * timing, 9) desc, source limit 3"),
    "E18_report": (lambda s, d: S.report(scored(s, d), "source"), "with " + PRE + """, c as (select source, least(1.0::double, avg(intensity) * 20) as problem, least(1.0::double, count(*)::double / 50) as market, count(*) as frequency, list_sort(list(distinct lang)) as affected from pre group by 1) select source, to_json({'frequency': frequency, 'affected': affected, 'sources': [source], 'quadrant': case when problem >= 0.5 then 'strong' else 'weak' end || '/' || case when market >= 0.5 then 'large' else 'small' end})::varchar as report from c"""),
    "E19_decisions": (lambda s, d: S.decide(table(s, d, "part").select(F.col("p_partkey").alias("idea_id"), F.lit("PENDING").alias("status")), table(s, d, "part").filter("p_size < 30").select(F.col("p_partkey").alias("idea_id"), F.element_at(F.array(*[F.lit(x) for x in ("approve", "hold", "discard", "rerun")]), F.col("p_size") % 4 + 1).alias("action"))), "select p_partkey as idea_id, case when p_size >= 30 then 'PENDING' when p_size % 4 = 0 then 'APPROVED' when p_size % 4 = 1 then 'HELD' when p_size % 4 = 2 then 'DISCARDED' else 'PENDING' end as status, case when p_size < 30 and p_size % 4 = 3 then 5 end as rerun_from, p_size < 30 and p_size % 4 = 0 as in_moderation from part"),
    "E15_kmeans": (clusters, None),
}
