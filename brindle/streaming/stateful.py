"""Streams with keyed state that ends: job progress and key/value rows, by state processors with event-time timers.

State lies in RocksDB, one small entry per key. What a micro-batch brings for a key comes in pieces; a piece goes into a
list in the state as it comes and is read back in order to be folded, so no frame holds all rows of a key. Rows may come
in any order inside a micro-batch, none with a smaller number in a later one. A timer clears a job ``keep_s`` seconds of
event time after its end, and a key at the end of its value, once the watermark has passed; what then comes late is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.streaming.progress import RESULT_TTL_S, TERMINAL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB = "stage string, result string, error string, seq bigint, events bigint, ended boolean"
PIECE = "seq bigint, stage string, result string, error string"


class Jobs(StatefulProcessor):
    """State of a job: last stage, last result and error, number of events up to its end."""

    def __init__(self, keep_s: int):
        self.keep_ms = 1000 * keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job, self.pieces = handle.getValueState("job", JOB), handle.getListState("pieces", PIECE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stage, result, error, seq, events, ended = self.job.get() if self.job.exists() else (None, None, None, -1, 0, False)
        end, at = None, 0
        for piece in rows:
            at = max(at, int(piece["at_ms"].max()))
            piece = piece[piece["seq"] > seq]
            if ended or not len(piece):
                continue
            last = piece.loc[piece["stage"].isin(TERMINAL), "seq"]
            end = min([x for x in (end, *last.tolist()) if x is not None], default=None)
            self.pieces.appendList([(int(s), g, r if isinstance(r, str) else None, e if isinstance(e, str) else None) for s, g, r, e in zip(piece["seq"], piece["stage"], piece["result"], piece["error"], strict=True)])
        if not ended and self.pieces.exists():
            first, latest, seen, by = seq, [seq, seq, seq], set(), [stage, result, error]
            for number, *values in self.pieces.get():
                if number <= first or (end is not None and number > end) or number in seen:
                    continue
                seen.add(number)
                for k, v in enumerate(values):
                    if v is not None and number > latest[k]:
                        latest[k], by[k] = number, v
            stage, result, error = by
            seq, events, ended = max([first, *seen]), events + len(seen), end is not None
            self.pieces.clear()
            self.job.update((stage, result, error, seq, events, ended))
            if ended:
                self.handle.registerTimer(at + self.keep_ms)
        yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "result": [result], "error": [error], "events": [events], "cleared": [False]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stage, result, error, _, events, _ = self.job.get()
        self.job.clear()
        yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "result": [result], "error": [error], "events": [events], "cleared": [True]})


class Values(StatefulProcessor):
    """The newest value of a key, until its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", "value string, at bigint, expires_at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.value.get() if self.value.exists() else None
        now = before
        for piece in rows:
            newest = piece.loc[piece["at"].idxmax()]
            if now is None or newest["at"] > now[1]:
                now = (newest["value"], int(newest["at"]), int(newest["expires_at"]))
        if now != before:
            if before is not None:
                self.handle.deleteTimer(before[2] + 1)
            self.value.update(now)
            # Alive at the very end.
            self.handle.registerTimer(now[2] + 1)
            yield pd.DataFrame({"key": [key[0]], "value": [now[0]], "expires_at": [now[2]], "live": [True]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        value, _, end = self.value.get()
        self.value.clear()
        yield pd.DataFrame({"key": [key[0]], "value": [value], "expires_at": [end], "live": [False]})


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def jobs(events: DataFrame, at: str = "at", late: str = "1 hour", keep_s: int = RESULT_TTL_S) -> DataFrame:
    """Update stream of job states (job_id, stage, result, error, events, cleared) of events (job_id, seq, stage, result,
    error and a time): a row each time a job changes, and one when its state is cleared."""
    use_rocksdb(events.sparkSession)
    e = events.withWatermark(at, late).withColumn("at_ms", F.unix_millis(at))
    schema = "job_id bigint, stage string, result string, error string, events bigint, cleared boolean"
    return e.groupBy("job_id").transformWithStateInPandas(Jobs(keep_s), schema, "Update", "EventTime")


def live_values(rows: DataFrame, at: str = "time", late: str = "0 seconds") -> DataFrame:
    """Update stream of a key/value store (key, value, at, expires_at in milliseconds, and the time of at as a timestamp):
    a row for each new value, and one with live false when the watermark has passed its end."""
    use_rocksdb(rows.sparkSession)
    e = rows.withWatermark(at, late)
    return e.groupBy("key").transformWithStateInPandas(Values(), "key string, value string, expires_at bigint, live boolean", "Update", "EventTime")


def append_once(rows: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that writes each micro-batch under its number: a batch that runs again after a restart from the
    checkpoint replaces its own rows, so each is there once. Every available row is taken, then the query ends."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
