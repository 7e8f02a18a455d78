"""Streams with state that ends, streams that go on after a stop, and event files read back. Events stand in for progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.stored import new_path
from brindle.plans.stream_queries import PR, progress, progress_of
from brindle.sources.event_text import read_events, stream_events, write_events
from brindle.sources.tables import SCHEMAS, table
from brindle.streaming import progress as T
from brindle.streaming import stateful as ST

KEEP_S, LATE_S = 432_000, 3_600
BODY = "stage string, result string, error string"


def job_stream(s: SparkSession, folder: str) -> DataFrame:
    e = s.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "*.parquet").parquet(folder)
    at = F.col("ts").cast("timestamp").alias("at")
    return ST.jobs(progress_of(e, at), "at", f"{LATE_S} seconds", KEEP_S)


def last_states(s: SparkSession, at: str) -> DataFrame:
    """The last row of each job: batches count up, and a state is cleared after its last change."""
    rows = s.read.parquet(at)
    last = F.max_by(F.struct("stage", "result", "error", "events", "cleared"), F.struct("batch", "cleared"))
    return rows.groupBy("job_id").agg(last.alias("r")).select("job_id", "r.*")


def state_jobs(s: SparkSession, d: str) -> DataFrame:
    """All events in one run; jobs that ended KEEP_S before the watermark are cleared."""
    folder = new_path(s, "job-stream")
    table(s, d, "events").write.parquet(f"{folder}/in")
    ST.append_once(job_stream(s, f"{folder}/in"), f"{folder}/rows", f"{folder}/checkpoint", "update").awaitTermination()
    return last_states(s, f"{folder}/rows")


def resumed_jobs(s: SparkSession, d: str) -> DataFrame:
    """The first half of the events, a stop, then the others, from the same checkpoint: states go on where they were."""
    folder, e = new_path(s, "job-stream"), table(s, d, "events")
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        e.filter(part).write.mode("append").parquet(f"{folder}/in")
        ST.append_once(job_stream(s, f"{folder}/in"), f"{folder}/rows", f"{folder}/checkpoint", "update").awaitTermination()
    return last_states(s, f"{folder}/rows")


def live_values(s: SparkSession, d: str) -> DataFrame:
    """Every event sets its user's key for five days; what the watermark has passed is gone."""
    folder = new_path(s, "value-stream")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    table(s, d, "events").select(F.concat(F.lit("wallet:"), F.col("user_id").cast("string")).alias("key"), F.concat_ws(":", "event_type", "event_id").alias("value"), micros.alias("at"), (F.floor(micros / 1000) + 1000 * KEEP_S).alias("expires_at"), F.col("ts").cast("timestamp").alias("time")).write.parquet(f"{folder}/in")
    rows = s.readStream.schema(s.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    ST.append_once(ST.live_values(rows), f"{folder}/rows", f"{folder}/checkpoint", "update").awaitTermination()
    last = F.max_by(F.struct("value", "expires_at", "live"), F.struct("batch", ~F.col("live")))
    return s.read.parquet(f"{folder}/rows").groupBy("key").agg(last.alias("r")).select("key", "r.*").filter("live").drop("live")


def events_back(s: SparkSession, d: str) -> DataFrame:
    at = new_path(s, "event-text")
    write_events(T.sse(progress(s, d)), at)
    body = F.from_json("data", BODY)
    return read_events(s, at).select(F.col("id").cast("bigint").alias("seq"), body.alias("b")).select("seq", "b.*")


def events_streamed_back(s: SparkSession, d: str) -> DataFrame:
    """The event files as a stream, each event once in the sink."""
    at = new_path(s, "event-text")
    write_events(T.sse(progress(s, d)), f"{at}/in")
    ST.append_once(stream_events(s, f"{at}/in"), f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return s.read.parquet(f"{at}/rows").select(F.col("id").cast("bigint").alias("seq"), F.from_json("data", BODY).alias("b")).select("seq", "b.*")


FOLD = "with " + PR + f""", f as (select job_id, arg_max(stage, seq) as stage, arg_max(result, seq) filter (result is not null) as result, arg_max(error, seq) filter (error is not null) as error, count(*) as events, bool_or(stage in ('done', 'error')) as ended from lv group by 1),
w as (select user_id as job_id, max(ts) as upto, (select max(ts) from events) as now from events group by 1)
select job_id, stage, result, error, events, """
BACK = "with " + PR + " select seq, stage, result, error from pr"

QUERIES = {
    "T1_T2_state_jobs": (state_jobs, FOLD + f"ended and epoch_us(upto) // 1000 + {1000 * KEEP_S} <= epoch_us(now) // 1000 - {1000 * LATE_S} as cleared from f join w using (job_id)"),
    "T9_resumed_jobs": (lambda s, d: resumed_jobs(s, d).drop("cleared"), FOLD.rstrip(", ") + " from f"),
    "S18_S19_live_values": (live_values, f"with v as (select 'wallet:' || user_id as key, arg_max(event_type || ':' || event_id, ts) as value, epoch_us(max(ts)) // 1000 + {1000 * KEEP_S} as expires_at from events group by 1) select * from v where expires_at >= (select epoch_us(max(ts)) // 1000 from events)"),
    "S17_read_back": (events_back, BACK),
    "S17_stream_back": (events_streamed_back, BACK),
}
