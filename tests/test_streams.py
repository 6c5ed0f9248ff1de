"""Stateful streams against their batch twins."""

import datetime

import pytest
from pyspark.sql import functions as F

from veldspar.sources.scratch import shared_folder
from veldspar.streaming import telemetry


def streamed(spark, df, order, files, operator):
    out = shared_folder(spark, "streams-out")
    telemetry.run_to_end(operator(telemetry.as_stream(df, shared_folder(spark, "streams"), order, files)), out, shared_folder(spark, "streams-check"))
    return spark.read.parquet(out)


def test_waits_are_held_over_many_batches(spark):
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    rows = [(1, 1, at(0), 0, "open"), (1, 2, at(10), 1, "open"), (2, 1, at(11), 2, "open"), (1, 3, at(20), 3, "open"), (1, 1, at(30), 4, "close"), (2, None, at(31), 5, "idle"), (1, 3, at(40), 6, "close"), (3, 9, at(300), 7, "open"), (3, 9, at(301), 8, "close")]
    events = spark.createDataFrame(rows, "session long, request long, ts timestamp, seq long, kind string")
    plain = lambda df: sorted(map(tuple, df.filter("state <> 'open'").select("session", "request", F.col("opened").cast("string"), "state", F.col("at").cast("string")).collect()))
    got = plain(streamed(spark, events, "seq", 9, lambda s: telemetry.waits(s, 60)))
    assert got == plain(telemetry.waits(events, 60, "2024-01-01 05:00:00"))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 1, "answered"), (1, 2, "expired"), (1, 3, "answered"), (2, 1, "cleared"), (3, 9, "answered")]


def test_token_deltas_of_sessions_that_share_a_state(spark):
    """Over several micro-batches, with falling totals, a null session and sessions from before the start."""
    old, new = datetime.datetime(2023, 12, 1), datetime.datetime(2024, 1, 2)
    rows = [(None if s == 4 else s, 10 * k + s, (k * (7 + s)) % 23, old if s % 2 else new) for k in range(1, 7) for s in range(5)]
    calls = spark.createDataFrame(rows, "session long, seq long, total long, created timestamp")
    got = streamed(spark, calls, "seq", 3, lambda s: telemetry.stream_token_deltas(s, "2024-01-01", buckets=2))
    want, last = [], {}
    for session, seq, total, created in sorted(rows, key=lambda r: r[1]):
        before = last.get(session, 0 if created == new else total)
        want.append((session, seq, max(0, total - before)))
        last[session] = total
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
    plan = telemetry.stream_token_deltas(telemetry.as_stream(calls, shared_folder(spark, "plans"), "seq"), "2024-01-01")
    assert "_bucket" in plan._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_micro_batches_of_many_files_stay_in_order(spark, monkeypatch, rows):
    """However many files a micro-batch has, it holds its stretch of the order and nothing else; ties stay together."""
    monkeypatch.setattr(telemetry, "ROWS_PER_FILE", rows)
    df = spark.range(60).select(F.when(F.col("id") < 50, F.col("id")).otherwise(90).alias("o"), "id").repartition(4)
    folder, seen = shared_folder(spark, "order"), []
    stream = telemetry.as_stream(df, folder, "o")
    keep = lambda batch, _: seen.append([r.o for r in batch.collect()])
    stream.writeStream.option("checkpointLocation", shared_folder(spark, "order-check")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    assert len(seen) == 3 and sorted(o for b in seen for o in b) == sorted(r.o for r in df.collect())
    assert all(max(a) < min(b) for a, b in zip(seen, seen[1:], strict=False))
    files = spark.read.parquet(folder).inputFiles()
    assert len(files) == 3 * -(-max(map(len, seen)) // rows)
    assert max(r["count"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()) < max(6 * rows, 61 if rows == 1000 else 0)
    assert telemetry.as_stream(df.limit(0), shared_folder(spark, "order"), "o").isStreaming


def test_todo_progress_aggregates_counts_instead_of_lists(spark):
    lists = spark.createDataFrame([(1, 1, [("a", "completed")]), (1, 2, [("c", "in_progress"), ("b", "in_progress"), ("d", "cancelled")]), (2, 1, None), (3, None, [("a", "completed")])], "session long, seq long, items array<struct<content string, status string>>")
    got = telemetry.todo_progress(lists)
    assert {r.session: (r.done, r.total, r.current) for r in got.collect()} == {1: (0, 2, "b"), 2: (None, None, None), 3: (None, None, None)}
    assert "max_by(items" not in got._jdf.queryExecution().optimizedPlan().toString()
