"""Job progress: a per-job stage machine, as a batch fold and as a stream.

Events are (job_id, seq, stage, result, error). The stages in order are STAGES; done and error end a job and later events
are dropped. A message that isn't valid JSON becomes an error event. Results are carried forward: the last one that isn't
null. Batch and stream give the same rows for jobs whose events reach the stream in order of seq; inside a micro-batch
any order will do, but of a later one no event with a smaller seq than one already seen is taken. A job's state is one
row and stays, so that an ended job can ignore what comes late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The stages in order, and the two that end a job.
STAGES = ("idle", "processing", "confirmed", "thinking", "researching", "evaluating", "stitching", "done", "error")
TERMINAL = ("done", "error")
EMITTED = ("confirmed", "thinking", "researching", "evaluating", "stitching", "done")
MESSAGE = "stage string, result string, error string"


def parse(messages: DataFrame, body: str = "message") -> DataFrame:
    """job_id, seq, stage, result, error from JSON messages; a malformed one is an error event."""
    m = F.from_json(body, MESSAGE)
    bad = m["stage"].isNull() | ~m["stage"].isin(*STAGES)
    return messages.withColumn("_m", m).select(
        "job_id", "seq", F.when(bad, "error").otherwise(F.col("_m.stage")).alias("stage"), F.when(~bad, F.col("_m.result")).alias("result"), F.when(bad, "Invalid message").otherwise(F.col("_m.error")).alias("error")
    )


def until_terminal(events: DataFrame) -> DataFrame:
    """Events up to and with the first terminal one of each job."""
    before = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("stage").isin(*TERMINAL)).over(before), F.lit(False))
    return events.withColumn("_ended", ended).filter("not _ended").drop("_ended")


def fold(events: DataFrame) -> DataFrame:
    """job_id, stage, result, error, events: the state of every job."""
    live = until_terminal(events)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq")))
    return live.groupBy("job_id").agg(F.max_by("stage", "seq").alias("stage"), last("result").alias("result"), last("error").alias("error"), F.count("*").alias("events"))


def carried(events: DataFrame) -> DataFrame:
    """Every event with the result known by then."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("result", F.last("result", ignorenulls=True).over(w))


def funnel(states: DataFrame) -> DataFrame:
    """How many jobs reached each emitted stage, by the place of their last stage."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    reached = states.filter("stage != 'error'").select(F.explode(F.array(*[F.when(place >= STAGES.index(s) + 1, s) for s in EMITTED])).alias("stage")).filter("stage is not null")
    return reached.groupBy("stage").agg(F.count("*").alias("n"))


def debounced(events: DataFrame, key: str, at: str, order: str, gap_ms: int = 350) -> DataFrame:
    """Events with no later one of the key within the gap."""
    w = Window.partitionBy(key).orderBy(at, order)
    gap = F.unix_micros(F.lead(at).over(w).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return events.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") >= gap_ms * 1000)).drop("_gap")


def without_repeats(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Events whose value differs from the one before."""
    prev = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return events.withColumn("_prev", prev).filter(~F.col("_prev").eqNullSafe(F.col(value))).drop("_prev")


def first_of(*sources: DataFrame, key: str = "job_id", value: str = "result") -> DataFrame:
    """The value of the first source that has one for a key."""
    both = [s.filter(F.col(value).isNotNull()).select(key, F.lit(i).alias("_from"), value) for i, s in enumerate(sources)]
    out = both[0]
    for b in both[1:]:
        out = out.unionByName(b)
    return out.groupBy(key).agg(F.min_by(value, "_from").alias(value), F.min("_from").alias("source"))


def retry_delays(attempts: DataFrame, first_ms: int = 2_000, most: int = 3) -> DataFrame:
    """delay_ms before each attempt after the first: doubled from first_ms; attempts beyond ``most`` are dropped."""
    n = F.col("attempt")
    return attempts.filter(n <= most).withColumn("delay_ms", F.when(n > 1, first_ms * F.pow(F.lit(2), n - 2)).otherwise(0).cast("bigint"))


def sse(events: DataFrame) -> DataFrame:
    """Server-sent-event text of each event, with the sequence number as its id."""
    body = F.to_json(F.struct("stage", "result", "error"))
    return events.select("job_id", "seq", F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\ndata: "), body, F.lit("\n\n")).alias("text"))


# Key/value rows (key, value, at, expires_at) in milliseconds; the newest row of a key counts.


def kv_set(store: DataFrame, key: str, value: str, now: int, ttl_s: int = 5) -> DataFrame:
    row = store.sparkSession.createDataFrame([(key, value, now, now + 1000 * ttl_s)], store.schema)
    return store.unionByName(row)


def kv_live(store: DataFrame, now: Column | int) -> DataFrame:
    """The newest row of each key that isn't past its end (alive at the very end)."""
    latest = store.groupBy("key").agg(F.max_by(F.struct("value", "expires_at"), "at").alias("r")).select("key", "r.value", "r.expires_at")
    return latest.filter(~(F.col("expires_at") < now))


#: Fixed value: how long a result is kept.
RESULT_TTL_S = 604_800


def store_results(done: DataFrame, ttl_s: int = RESULT_TTL_S) -> DataFrame:
    """Key/value rows of finished jobs (job_id, result, completed_at in milliseconds): the report as JSON, and its end."""
    body = F.to_json(F.struct(F.col("result").alias("report"), F.col("completed_at").alias("completedAt")))
    key = F.concat(F.lit("job:"), F.col("job_id").cast("string"), F.lit(":result"))
    return done.select(key.alias("key"), body.alias("value"), F.col("completed_at").alias("at"), (F.col("completed_at") + 1000 * ttl_s).alias("expires_at"))


def read_results(store: DataFrame, now: Column | int) -> DataFrame:
    """job_id, report, completed_at of the results that are still kept."""
    r = F.from_json("value", "report string, completedAt bigint")
    live = kv_live(store, now).withColumn("_r", r)
    return live.select(F.regexp_extract("key", "^job:(.*):result$", 1).alias("job_id"), F.col("_r.report").alias("report"), F.col("_r.completedAt").alias("completed_at"))


def retries(events: DataFrame, job: str, at: str, order: str, failed: Column, first_ms: int = 2_000, most: int = 3) -> DataFrame:
    """The failed attempts of each job in order: attempt, retry_ms (the wait before the next one, doubled from first_ms)
    and given_up, from the attempt numbered ``most`` on."""
    nth = F.row_number().over(Window.partitionBy(job).orderBy(at, order))
    out = events.filter(failed).withColumn("attempt", nth)
    up = F.col("attempt") >= most
    return out.withColumn("retry_ms", F.when(~up, first_ms * F.pow(F.lit(2), F.col("attempt") - 1)).cast("bigint")).withColumn("given_up", up)


def sliding_counts(events: DataFrame, at: str = "ts", width: str = "1 day", step: str = "12 hours") -> DataFrame:
    return events.groupBy(F.window(F.col(at).cast("timestamp"), width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def joined_streams(left: DataFrame, right: DataFrame, key: str, at: str, within: str = "1 hour", late: str = "1 day") -> DataFrame:
    """left_id, right_id: each left event with the right ones of its key in the time before it; state is kept as long as
    the watermark asks for."""
    a = left.select(F.col(key).alias("_k"), F.col("event_id").alias("left_id"), F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", late)
    b = right.select(F.col(key).alias("_j"), F.col("event_id").alias("right_id"), F.col(at).cast("timestamp").alias("_by")).withWatermark("_by", late)
    on = (F.col("_k") == F.col("_j")) & (F.col("_by") <= F.col("_at")) & (F.col("_by") >= F.col("_at") - F.expr(f"interval {within}"))
    return a.join(b, on).select("left_id", "right_id")


def distinct_events(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once, if its copies come within the watermark's delay of each other."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def kv_delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key"), "key", "left_anti")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    stage, result, error, seq, n, ended = state.get if state.exists else (None, None, None, -1, 0, False)
    rows = pd.concat([b[b["seq"] > seq] for b in batches] if not ended else [b[:0] for b in batches]).sort_values("seq").drop_duplicates("seq")
    ends = rows["stage"].isin(TERMINAL).to_numpy()
    rows = rows.iloc[: int(ends.argmax()) + 1] if ends.any() else rows
    if len(rows):
        last = lambda c, before: rows[c].dropna().iloc[-1] if rows[c].notna().any() else before
        stage, seq, n, ended = rows["stage"].iloc[-1], int(rows["seq"].iloc[-1]), n + len(rows), bool(ends.any())
        result, error = last("result", result), last("error", error)
    state.update((stage, result, error, seq, n, ended))
    yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "result": [result], "error": [error], "events": [n]})


def fold_stream(events: DataFrame) -> DataFrame:
    """Update-mode stream of job states. State per job is one row; an ended job ignores what follows."""
    return events.groupBy("job_id").applyInPandasWithState(
        _step,
        outputStructType="job_id bigint, stage string, result string, error string, events bigint",
        stateStructType="stage string, result string, error string, seq bigint, n bigint, ended boolean",
        outputMode="update",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def read_jobs(spark: SparkSession, path: str, schema: str, glob: str = "*.parquet") -> DataFrame:
    """A stream over a folder of job or event files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tumbling counts by type with a watermark, for streams and tables alike."""
    e = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return e.groupBy(F.window("_at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
