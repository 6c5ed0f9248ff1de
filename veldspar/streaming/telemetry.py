"""Telemetry operators for streams and batches.

Streams get a watermark on the event time; rows behind it are dropped and counted by Spark. Stateful operators keep
small state per key in Spark's state store, which the query's checkpoint folder recovers; their timers run on event
time, so that a replay gives the same rows. filled_series, stale, alerts and late_rows take finished tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "30 seconds"
ROWS_PER_FILE = 1 << 17


def _marked(events: DataFrame, time: str, late: str = LATE) -> DataFrame:
    return events.withWatermark(time, late) if events.isStreaming else events


def usage(events: DataFrame, every: str = "10 seconds", late: str = LATE) -> DataFrame:
    """Tokens in and out per window and instance; out holds reasoning. events: ts, instance, tokens_in, tokens_out,
    reasoning."""
    w = F.window("ts", every)
    return _marked(events, "ts", late).groupBy(w.alias("w"), "instance").agg(F.sum("tokens_in").alias("tokens_in"), F.sum(F.col("tokens_out") + F.col("reasoning")).alias("tokens_out")).select(F.col("w.start").alias("bucket"), "instance", "tokens_in", "tokens_out")


def rates(events: DataFrame, late: str = LATE) -> DataFrame:
    """Tokens of the minute that ends every ten seconds, per instance."""
    return _marked(events, "ts", late).groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w"), "instance").agg(F.sum(F.col("tokens_in") + F.col("tokens_out") + F.col("reasoning")).alias("per_minute")).select(F.col("w.end").alias("at"), "instance", "per_minute")


def filled_series(buckets: DataFrame, last: str, n: int, seconds: int, value: str) -> DataFrame:
    """The last n buckets up to a moment with zeros for missing ones, and the largest of them."""
    end = F.lit(last).cast("timestamp")
    axis = buckets.sparkSession.range(n).select(F.timestamp_seconds(F.unix_timestamp(end) - F.col("id") * seconds).alias("bucket"))
    sums = buckets.groupBy("bucket").agg(F.sum(value).alias(value))
    series = F.broadcast(axis).join(sums, "bucket", "left").select("bucket", F.coalesce(value, F.lit(0)).alias(value))
    return series.join(F.broadcast(series.agg(F.max(value).alias("peak"))))


def latest_status(events: DataFrame) -> DataFrame:
    """Each session's latest state, on streams too (update or complete mode). events: session, ts, seq, status (null for events
    that don't change it)."""
    return events.filter("status is not null").groupBy("session").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("since"))


_WAITS = "session long, request long, opened timestamp, state string, at timestamp"


def waits(events: DataFrame, expiry_minutes: int = 30, as_of: str | None = None, late: str = LATE) -> DataFrame:
    """(session, request, opened, state, at): how each opened wait ended: answered (its request closed), cleared (its session idle)
    or expired, whichever came first; at is when. A request that is opened again while it waits starts anew, without a row.
    events: session, request (null for idle), ts, seq, kind (open, close, idle).

    On a stream the open requests of a session are its state, and a timer on event time expires them. A batch also gives
    what is open at the moment as_of (without it, the last event's time), and expires by it."""
    return _wait_stream(events, expiry_minutes, late) if events.isStreaming else _wait_batch(events, expiry_minutes, as_of)


def _wait_batch(events: DataFrame, expiry_minutes: int, as_of: str | None) -> DataFrame:
    now = F.lit(as_of).cast("timestamp") if as_of else F.max("ts").over(Window.partitionBy())
    if as_of is None:
        now = F.lit(events.agg(F.max("ts")).first()[0])
    later = lambda *key: Window.partitionBy(*key).orderBy("ts", "seq").rowsBetween(1, Window.unboundedFollowing)
    moment = F.struct("ts", "seq", "kind")
    own = F.first(F.when(F.col("kind").isin("close", "open"), moment), ignorenulls=True).over(later("session", "request"))
    idle = F.first(F.when(F.col("kind") == "idle", moment), ignorenulls=True).over(later("session"))
    ended = events.withColumns({"_own": own, "_idle": idle}).filter("kind = 'open'")
    first = F.least("_own", "_idle")  # nulls don't count
    limit = F.timestamp_micros(F.unix_micros("ts") + expiry_minutes * 60_000_000)
    out = ended.withColumns({"_e": first, "_limit": limit})
    expired = (F.col("_limit") < F.coalesce(F.col("_e.ts"), F.lit("9999-12-31").cast("timestamp"))) & (F.col("_limit") <= now)
    state = F.when(expired, "expired").when(F.col("_e").isNull(), "open").when(F.col("_e.kind") == "close", "answered").when(F.col("_e.kind") == "idle", "cleared")
    return out.select("session", "request", F.col("ts").alias("opened"), state.alias("state"), F.when(expired, F.col("_limit")).otherwise(F.col("_e.ts")).alias("at")).filter("state is not null")


def _wait_stream(events: DataFrame, expiry_minutes: int, late: str) -> DataFrame:
    span = pd.Timedelta(minutes=expiry_minutes)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {r: pd.Timestamp(t) for r, t in zip(*state.get, strict=True)} if state.exists else {}  # the state gives datetimes
        out: list[tuple] = []

        def expire(now: pd.Timestamp) -> None:
            for request in [r for r, t in held.items() if t + span < now]:
                out.append((key[0], request, held[request], "expired", held.pop(request) + span))

        if state.hasTimedOut:
            expire(pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms") + pd.Timedelta(milliseconds=1))
        else:
            some = pd.concat([f for f in frames if len(f)])
            for row in some.sort_values(["ts", "seq"]).itertuples():
                expire(row.ts)
                if row.kind == "open":
                    held[int(row.request)] = row.ts
                elif row.kind == "close" and int(row.request) in held:
                    out.append((key[0], int(row.request), held.pop(int(row.request)), "answered", row.ts))
                elif row.kind == "idle":
                    out += [(key[0], r, t, "cleared", row.ts) for r, t in held.items()]
                    held.clear()
        if held:
            state.update((list(held), [t.to_pydatetime() for t in held.values()]))
            state.setTimeoutTimestamp(max(int((min(held.values()) + span).timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["session", "request", "opened", "state", "at"])

    small = events.select("session", "request", "ts", "seq", "kind").filter("kind in ('open', 'close', 'idle')")
    return small.withWatermark("ts", late).groupBy("session").applyInPandasWithState(run, _WAITS, "requests array<long>, opened array<timestamp>", "append", GroupStateTimeout.EventTimeTimeout)


def busy_timeouts(events: DataFrame, hours: float = 3, as_of: str | None = None, late: str = LATE) -> DataFrame:
    """(root, since, at): roots that were busy for so long without another event: taken as lost at that moment. events: root, ts, seq,
    status (busy, idle or another). On a stream a timer on event time finds roots that have fallen silent; a batch
    judges by the moment as_of (without it, the last event's time)."""
    span = pd.Timedelta(hours=hours)
    if not events.isStreaming:
        now = F.lit(as_of).cast("timestamp") if as_of else F.lit(events.agg(F.max("ts")).first()[0])
        following = F.lead("ts").over(Window.partitionBy("root").orderBy("ts", "seq"))
        at = F.timestamp_micros(F.unix_micros("ts") + int(span.total_seconds() * 1e6))
        found = events.withColumns({"_next": following, "at": at}).filter("status = 'busy'")
        return found.filter((F.col("at") <= now) & (F.col("_next").isNull() | (F.col("at") < F.col("_next")))).select("root", F.col("ts").alias("since"), "at")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((key[0], since, since + span))
            since = None
        else:
            some = pd.concat([f for f in frames if len(f)])
            for row in some.sort_values(["ts", "seq"]).itertuples():
                if since is not None and since + span < row.ts:
                    out.append((key[0], since, since + span))
                since = row.ts if row.status == "busy" else None
        if since is not None:
            state.update((since.to_pydatetime(),))
            state.setTimeoutTimestamp(max(int((since + span).timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["root", "since", "at"])

    small = events.select("root", "ts", "seq", "status").withWatermark("ts", late)
    return small.groupBy("root").applyInPandasWithState(run, "root long, since timestamp, at timestamp", "since timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def tool_calls(running: DataFrame, ended: DataFrame, within: str = "1 hour") -> DataFrame:
    """Running tool calls with their ends, joined by call id within a time; stream-stream or batch. running: call_id, ts;
    ended: call_id, ts, outcome."""
    a = _marked(running.select("call_id", F.col("ts").alias("started")), "started", within)
    b = _marked(ended.select(F.col("call_id").alias("_id"), F.col("ts").alias("finished"), "outcome"), "finished", within)
    on = (F.col("call_id") == F.col("_id")) & (F.col("finished") >= F.col("started")) & (F.col("finished") <= F.col("started") + F.expr(f"interval {within}"))
    return a.join(b, on, "left").select("call_id", "started", "outcome", ((F.unix_micros("finished") - F.unix_micros("started")) / 1000).alias("ms"))


def todo_progress(lists: DataFrame) -> DataFrame:
    """Of each session's latest list, on streams too (update or complete mode): items done, all but the cancelled ones, and the current item. lists: session, seq,
    items array<struct<content, status>>. Lists are counted before they are sorted by session: what is sorted is small."""
    of = lambda s: F.filter("items", lambda i: i["status"] == s)
    counted = F.struct(F.size(of("completed")).alias("done"), F.size(F.filter("items", lambda i: i["status"] != "cancelled")).alias("total"), F.get(F.array_sort(F.transform(of("in_progress"), lambda i: i["content"])), F.lit(0)).alias("current"))
    last = lists.select("session", "seq", counted.alias("_c")).groupBy("session").agg(F.max_by("_c", "seq").alias("_c"))
    return last.select("session", "_c.done", "_c.total", "_c.current")


def event_counts(events: DataFrame, every: str = "1 hour", late: str = LATE) -> DataFrame:
    """Events and errors per window and instance; an abort is no error. events: ts, instance, kind, aborted."""
    return _marked(events, "ts", late).groupBy(F.window("ts", every).alias("w"), "instance").agg(F.count("*").alias("events"), F.count_if((F.col("kind") == "error") & ~F.col("aborted")).alias("errors")).select(F.col("w.start").alias("bucket"), "instance", "events", "errors")


def agent_changes(events: DataFrame) -> DataFrame:
    """(session, seq, agent, was): where a session's agent is another than before. events: session, ts, seq, agent (null where an
    event names none). On a stream the last agent of a session is its state; rows of one micro-batch are taken in order."""
    named = events.select("session", "ts", "seq", "agent").filter("agent is not null")
    if not events.isStreaming:
        before = F.lag("agent").over(Window.partitionBy("session").orderBy("ts", "seq"))
        return named.withColumn("was", before).filter("was <> agent").select("session", "seq", "agent", "was")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        some = pd.concat([f for f in frames if len(f)]).sort_values(["ts", "seq"])
        some["was"] = some["agent"].shift()
        some.iloc[0, some.columns.get_loc("was")] = state.get[0] if state.exists else None
        state.update((some["agent"].iloc[-1],))
        changed = some[some["was"].notna() & (some["was"] != some["agent"])]
        if len(changed):
            yield changed[["session", "seq", "agent", "was"]]

    return named.groupBy("session").applyInPandasWithState(run, "session long, seq long, agent string, was string", "agent string", "append", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, key: str, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    """Stretches of activity that end after a gap."""
    return _marked(events, "ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("until"), "n")


def alerts(events: DataFrame) -> DataFrame:
    """Alert times: 15, 5 and 1 minutes before events with a place, 5 and 1 before others. events: id, start, place."""
    minutes = F.when(F.col("place").isNotNull(), F.array(F.lit(15), F.lit(5), F.lit(1))).otherwise(F.array(F.lit(5), F.lit(1)))
    return events.select("id", "start", F.explode(minutes).alias("minutes")).select("id", "minutes", F.timestamp_seconds(F.unix_micros("start") / 1_000_000 - F.col("minutes") * 60).alias("at"))


def stale(events: DataFrame, key: str, as_of: str, seconds: int) -> DataFrame:
    """Keys whose last beat is older than so many seconds: runs without a beat, roots that are busy for too long."""
    last = events.groupBy(key).agg(F.max("ts").alias("beat"))
    return last.withColumn("stale", F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("beat") > seconds * 1_000_000)


def stream_token_deltas(events: DataFrame, started: str, slack_seconds: int = 5, buckets: int = 1024) -> DataFrame:
    """The token delta of windows.token_deltas as keyed state on a stream: (session, seq, delta). Sessions share ``buckets``
    states of last totals by session, as a call for each session would cost more than its rows; null is a session."""
    since = pd.Timestamp(started) - pd.Timedelta(seconds=slack_seconds)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        some = pd.concat([f for f in frames if len(f)])
        some = some[some["created"].notna()]
        if len(some):
            last = dict(zip(*state.get, strict=True)) if state.exists else {}
            some["_s"] = 0 if key[0] < 0 else some["session"].astype("int64")
            some = some.sort_values(["_s", "seq"])
            by = some.groupby("_s")
            heads = ~some["_s"].duplicated()
            starts = zip(some.loc[heads, "_s"], some.loc[heads, "created"], some.loc[heads, "total"], strict=True)
            firsts = [last[s] if s in last else 0 if created >= since else total for s, created, total in starts]
            prior = some["total"].shift(fill_value=0).to_numpy().copy()
            prior[heads.to_numpy()] = firsts
            some["delta"] = (some["total"] - prior).clip(lower=0).astype("int64")
            last.update(by["total"].last().items())
            state.update(([int(s) for s in last], [int(t) for t in last.values()]))
            yield some[["session", "seq", "delta"]]

    bucket = F.when(F.col("session").isNull(), -1).otherwise(F.pmod(F.xxhash64("session"), F.lit(buckets)).cast("int"))
    return events.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(run, "session long, seq long, delta long", "sessions array<long>, last array<long>", "append", GroupStateTimeout.NoTimeout)


def deduplicated(fragments: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of the fragments of a topic with one key, within the watermark."""
    return fragments.withWatermark("ts", late).dropDuplicatesWithinWatermark(["topic", "key"]) if fragments.isStreaming else fragments.dropDuplicates(["topic", "key"])


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what its source holds now into Parquet files, and stop."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()


def as_stream(df: DataFrame, folder: str, order: str, files: int = 3) -> DataFrame:
    """A batch as a stream of a few micro-batches in order of a column: for tests and replays. They are written one after the
    other, as a stream takes files by age, and each as the same number of files (of about ROWS_PER_FILE rows), so that tasks
    stay small however large a micro-batch is."""
    spark: SparkSession = df.sparkSession
    df.repartitionByRange(files, order).withColumn("_file", F.spark_partition_id()).write.parquet(f"{folder}-parts")
    parts = spark.read.schema(df.withColumn("_file", F.lit(0)).schema).parquet(f"{folder}-parts")
    counts = {r["_file"]: r["count"] for r in parts.groupBy("_file").count().collect()}
    each = max(1, -(-max(counts.values(), default=0) // ROWS_PER_FILE))
    for done, k in enumerate(sorted(counts) or [0], 1):
        part = parts.filter(F.col("_file") == k).drop("_file")
        dealt = part.withColumn("_row", F.monotonically_increasing_id()).repartition(each, "_row").drop("_row") if each > 1 else part.coalesce(1)
        dealt.write.mode("append").parquet(folder)
        for _ in range(done * each - len(spark.read.schema(df.schema).parquet(folder).inputFiles())):  # tasks without rows write none
            part.filter(F.lit(False)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(folder)


def latest_table(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream of latest values (an aggregate) over what its source holds now, and leave its result as a table."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def late_rows(events: DataFrame, seen: Column, late_seconds: int) -> DataFrame:
    """Which rows a watermark drops, if the largest time known before a row's batch is ``seen``: those not above it less the delay.
    A batch twin for LateRows."""
    mark = F.floor(F.unix_micros(seen) / 1000) * 1000 - late_seconds * 1_000_000  # watermarks are whole milliseconds
    return events.withColumn("late", F.coalesce(F.unix_micros("ts") <= mark, F.lit(False)))


class LateRows(StreamingQueryListener):
    """Counts what streams read (by observe, under the name ``rows``) and what their stateful operators drop as late.

    Add it to spark.streams; a stream is ``counted`` to take part."""

    def __init__(self) -> None:
        self.rows, self.late, self.ended = 0, 0, False

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        row = event.progress.observedMetrics.get("rows")
        self.rows += row["n"] if row is not None else 0
        self.late += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.ended = True


def counted(stream: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """The stream's rows that aren't late, each key once, with the counts that LateRows takes."""
    return stream.observe("rows", F.count(F.lit(1)).alias("n")).withWatermark("ts", late).dropDuplicates([key, "ts"])
