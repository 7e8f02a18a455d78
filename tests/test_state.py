"""Streams with keyed state: ends, clearing, restarts; and event files cut between events."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import snapshots as M
from brindle.operators.windows import carried_before
from brindle.sources.event_text import read_events, write_events
from brindle.streaming import stateful as ST

ROWS = "job_id bigint, seq bigint, stage string, result string, error string, at timestamp"


def _put(spark, folder, rows):
    df = spark.createDataFrame([(j, n, g, r, e, at) for j, n, g, r, e, at in rows], "job_id bigint, seq bigint, stage string, result string, error string, at bigint")
    df.withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, tmp_path):
    rows = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
    q = ST.append_once(ST.jobs(rows, "at", "10 seconds", keep_s=100), f"file://{tmp_path}/rows", f"file://{tmp_path}/ck", "update")
    q.awaitTermination()
    out = spark.read.parquet(f"file://{tmp_path}/rows")
    last = out.groupBy("job_id").agg(F.max_by(F.struct("stage", "result", "error", "events", "cleared"), F.struct("batch", "cleared")).alias("r"))
    return {r.job_id: tuple(r.r) for r in last.collect()}, q


def test_jobs_end_and_are_cleared(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    # Out of order, a repeated number, rows behind the end.
    _put(spark, folder, [(1, 3, "done", "r3", None, 30), (1, 1, "thinking", "r1", None, 10), (1, 2, "researching", None, None, 20), (1, 2, "researching", None, None, 20), (1, 4, "thinking", "r4", None, 40), (2, 1, "thinking", None, None, 10)])
    got, _ = _run(spark, tmp_path)
    assert got == {1: ("done", "r3", None, 3, False), 2: ("thinking", None, None, 1, False)}
    _put(spark, folder, [(2, 2, "evaluating", "x", None, 60), (1, 5, "error", None, "late", 60), (3, 1, "error", None, "bad", 100)])
    got, _ = _run(spark, tmp_path)
    assert got == {1: ("done", "r3", None, 3, False), 2: ("evaluating", "x", None, 2, False), 3: ("error", None, "bad", 1, False)}
    _put(spark, folder, [(4, 1, "thinking", None, None, 1_000)])
    got, _ = _run(spark, tmp_path)
    _put(spark, folder, [(4, 2, "stitching", None, None, 1_001)])
    got, q = _run(spark, tmp_path)
    assert got[1] == ("done", "r3", None, 3, True) and got[3] == ("error", None, "bad", 1, True)
    assert got[2] == ("evaluating", "x", None, 2, False) and got[4] == ("stitching", None, None, 2, False)


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{x}" for x in ("in", "rows", "ck"))
    spark.range(0, 50).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("id bigint").parquet(src)
    ST.append_once(stream(), out, ck).awaitTermination()
    spark.range(50, 90).coalesce(1).write.mode("append").parquet(src)

    def fails(batch, n):  # as append_once, but lost after its rows are written
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream().writeStream.foreachBatch(fails).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    ST.append_once(stream(), out, ck).awaitTermination()
    ST.append_once(stream(), out, ck).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(90))


def test_event_files_in_many_splits(spark, tmp_path):
    rows = [(k, f"id: {k}\nevent: step\n: a comment\ndata: {{\"k\":\ndata:  {k}}}\n\n") for k in range(3_000)] + [(9_000, "id: 9000\n\n"), (9_001, "data\n\n"), (9_002, "data:\n\n")]
    at = f"file://{tmp_path}/text"
    write_events(spark.createDataFrame(rows, "k int, text string").coalesce(1), at)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = read_events(spark, at)
        assert got.rdd.getNumPartitions() > 10
        found = {r.id: (r.event, r.data) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {str(k): ("step", f'{{"k":\n {k}}}') for k in range(3_000)} | {None: (None, "")}


def test_versions_swap_without_a_gap(spark, tmp_path):
    at, schema = f"file://{tmp_path}/table", "id bigint"
    assert M.current_version(spark, at, schema).collect() == []
    M.publish_version(spark, spark.range(3), at, "b1")
    held = M.current_version(spark, at, schema)
    M.publish_version(spark, spark.range(10, 15), at, "b2")
    M.publish_version(spark, spark.range(99), at, "b1")  # is there
    assert sorted(r.id for r in held.collect()) == [0, 1, 2]
    assert sorted(r.id for r in M.current_version(spark, at, schema).collect()) == [10, 11, 12, 13, 14]
    for k in range(3, 13):
        M.publish_version(spark, spark.range(k), at, f"b{k}")
    assert M.current_version(spark, at, schema).count() == 12


@pytest.mark.parametrize("piece_rows", [50, 1_000_000])
def test_carried_over_ranges_of_rows(spark, piece_rows):
    rnd = random.Random(3)
    rows = [(k, rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(40), rnd.choice([None, 1, 2, 3])) for k in range(600)]
    df = spark.createDataFrame(rows, "id int, k string, at int, v int")
    got = carried_before(df, ["k"], ["at", "id"], None, F.col("v"), "s", piece_rows=piece_rows)
    got = {r.id: (r.s, r.l) for r in carried_before(got, ["k"], ["at", "id"], None, F.col("v"), "l", last=True, piece_rows=piece_rows).collect()}
    for i, k, at, _ in rows:
        before = [v for j, g, b, v in sorted(rows, key=lambda r: (r[2], r[0])) if g == k and (b, j) < (at, i) and v is not None]
        assert got[i] == (sum(before), before[-1] if before else None)
