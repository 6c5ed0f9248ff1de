"""Telemetry (ST, IO4, IO5, IO10): batch twins, and streams over events replayed from files."""

from __future__ import annotations

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from veldspar.plans.q_joins import _CAL, calendar
from veldspar.plans.registry import query, rounded, table
from veldspar.sources import files
from veldspar.sources.scratch import shared_folder
from veldspar.streaming import telemetry as t


def events(spark, d):
    n = F.round("value").cast("long")
    i = F.col("event_type").isin("purchase", "click")
    return table(spark, d, "events").select("ts", F.col("event_id").alias("seq"), F.col("user_id").alias("session"), (F.col("user_id") % 4).alias("instance"), F.when(i, n).otherwise(0).alias("tokens_in"), F.when(~i, n).otherwise(0).alias("tokens_out"), (n % 7).alias("reasoning"), F.col("event_type").alias("kind"), (F.col("event_id") % 5 == 0).alias("aborted"))


_E = "e AS (SELECT ts, event_id AS seq, user_id AS session, user_id % 4 AS instance, CASE WHEN event_type IN ('purchase', 'click') THEN round(value)::BIGINT ELSE 0 END AS i, CASE WHEN event_type IN ('purchase', 'click') THEN 0 ELSE round(value)::BIGINT END AS o, round(value)::BIGINT % 7 AS r, event_type AS kind, event_id % 5 = 0 AS aborted FROM events)"
_USAGE = f"WITH {_E} SELECT time_bucket(INTERVAL 10 SECOND, ts) AS bucket, instance, sum(i)::BIGINT AS tokens_in, sum(o + r)::BIGINT AS tokens_out FROM e GROUP BY 1, 2"


@query(_USAGE)
def st1_usage(spark, d):
    return t.usage(events(spark, d))


@query(_USAGE)
def st1_usage_stream(spark, d):
    """The stream's windows close when the watermark passes them; update mode would repeat them, so all are emitted in
    one complete result at the end."""
    src = t.as_stream(events(spark, d), shared_folder(spark, "st1"), "ts")
    out = shared_folder(spark, "st1-out")

    def keep(df, _):
        df.write.mode("overwrite").parquet(out)

    t.usage(src, late="40 days").writeStream.outputMode("complete").option("checkpointLocation", shared_folder(spark, "st1-check")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(out)


@query("WITH e AS (SELECT user_id AS session, event_id AS seq, sum(round(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS total, min(ts) OVER (PARTITION BY user_id) AS created FROM events) SELECT session, seq, greatest(0, total - coalesce(lag(total) OVER (PARTITION BY session ORDER BY seq), CASE WHEN created >= TIMESTAMP '2024-01-01' - INTERVAL 5 SECOND THEN 0 ELSE total END))::BIGINT AS delta FROM e")
def st2_token_deltas_stream(spark, d):
    by = Window.partitionBy("user_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.sum(F.round("value").cast("long")).over(by.orderBy("event_id")).alias("total"), F.min("ts").over(by).alias("created"))
    src, out = t.as_stream(e, shared_folder(spark, "st2"), "seq"), shared_folder(spark, "st2-out")
    t.run_to_end(t.stream_token_deltas(src, "2024-01-01"), out, shared_folder(spark, "st2-check"))
    return spark.read.parquet(out)


@query(f"WITH {_E}, x AS (SELECT unnest(range(6)) AS k) SELECT time_bucket(INTERVAL 10 SECOND, ts) + to_seconds(10 * (k + 1)) AS at, instance, sum(i + o + r)::BIGINT AS per_minute FROM e, x GROUP BY 1, 2")
def st3_rates(spark, d):
    return t.rates(events(spark, d))


@query(f"WITH {_E}, b AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) AS bucket, sum(i)::BIGINT AS tokens_in FROM e GROUP BY 1), a AS (SELECT TIMESTAMP '2024-01-02' - to_seconds(10 * n) AS bucket FROM range(720) r(n)), s AS (SELECT bucket, coalesce(tokens_in, 0)::BIGINT AS tokens_in FROM a LEFT JOIN b USING (bucket)) SELECT *, (SELECT max(tokens_in) FROM s) AS peak FROM s")
def st4_series(spark, d):
    return t.filled_series(t.usage(events(spark, d)), "2024-01-02", 720, 10, "tokens_in")


_ST5 = f"WITH {_E}, s AS (SELECT *, CASE kind WHEN 'view' THEN 'busy' WHEN 'signup' THEN 'idle' WHEN 'error' THEN 'retry' END AS status FROM e) SELECT session, arg_max(status, (ts, seq)) AS status, max(ts) AS since FROM s WHERE status IS NOT NULL GROUP BY 1"


@query(_ST5)
def st5_status(spark, d):
    return t.latest_status(_status(spark, d))


def _replayed(spark, df, order, tag, files=3):
    return t.as_stream(df, shared_folder(spark, tag), order, files)


def _status(spark, d):
    s = F.when(F.col("kind") == "view", "busy").when(F.col("kind") == "signup", "idle").when(F.col("kind") == "error", "retry")
    return events(spark, d).withColumn("status", s)


@query(_ST5)
def st5_status_stream(spark, d):
    out = shared_folder(spark, "st5-out")
    t.latest_table(t.latest_status(_replayed(spark, _status(spark, d), "ts", "st5")), out, shared_folder(spark, "st5-check"))
    return spark.read.parquet(out)


def _requests(spark, d):
    """Clicks open a request of their session, purchases close it, signups are idle."""
    kind = F.when(F.col("kind") == "click", "open").when(F.col("kind") == "purchase", "close").when(F.col("kind") == "signup", "idle")
    request = F.when(F.col("kind") != "signup", F.col("seq") % 3)
    return events(spark, d).select("session", request.alias("request"), "ts", "seq", kind.alias("kind")).filter("kind is not null")


#: Waits that end within ten hours, or don't, by the end of the data less the stream's delay.
_WAITED = """WITH e AS (SELECT user_id AS session, CASE WHEN event_type <> 'signup' THEN event_id % 3 END AS request, ts, event_id AS seq, CASE event_type WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'close' WHEN 'signup' THEN 'idle' END AS kind FROM events WHERE event_type IN ('click', 'purchase', 'signup')),
x AS (SELECT *, min(CASE WHEN kind IN ('close', 'open') THEN (ts, seq, kind) END) OVER (PARTITION BY session, request ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS own, min(CASE WHEN kind = 'idle' THEN (ts, seq, kind) END) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS idle FROM e),
y AS (SELECT *, CASE WHEN idle IS NULL OR own < idle THEN own ELSE idle END AS n, ts + INTERVAL 10 HOUR AS until FROM x WHERE kind = 'open'), z AS (SELECT max(ts) - INTERVAL 30 SECOND AS now FROM e),
s AS (SELECT session, request, ts AS opened, CASE WHEN until <= now AND (n IS NULL OR until < n[1]) THEN 'expired' WHEN n IS NULL THEN 'open' WHEN n[3] = 'close' THEN 'answered' WHEN n[3] = 'idle' THEN 'cleared' END AS state, CASE WHEN until <= now AND (n IS NULL OR until < n[1]) THEN until ELSE n[1] END AS "at" FROM y, z) SELECT * FROM s WHERE state IS NOT NULL"""


def _end(df):
    return str(df.agg(F.timestamp_micros(F.unix_micros(F.max("ts")) - 30_000_000)).first()[0])


@query(_WAITED)
def st6_waits(spark, d):
    r = _requests(spark, d)
    return t.waits(r, 600, _end(r))


@query(_WAITED + " AND state <> 'open'")
def st6_waits_stream(spark, d):
    out = shared_folder(spark, "st6-out")
    t.run_to_end(t.waits(_replayed(spark, _requests(spark, d), "ts", "st6"), 600), out, shared_folder(spark, "st6-check"))
    return spark.read.parquet(out)


@query("WITH o AS (SELECT event_id AS call_id, ts FROM events WHERE event_type = 'click'), c AS (SELECT event_id - 1 AS call_id, ts, event_type AS outcome FROM events WHERE event_type IN ('purchase', 'error')) SELECT o.call_id, o.ts AS started, outcome, round((epoch_us(c.ts) - epoch_us(o.ts)) / 1000, 3) AS ms FROM o LEFT JOIN c ON o.call_id = c.call_id AND c.ts >= o.ts AND c.ts <= o.ts + INTERVAL 1 HOUR")
def st7_tool_calls(spark, d):
    e = table(spark, d, "events")
    return rounded(t.tool_calls(e.filter("event_type = 'click'").select(F.col("event_id").alias("call_id"), "ts"), e.filter("event_type in ('purchase', 'error')").select((F.col("event_id") - 1).alias("call_id"), "ts", F.col("event_type").alias("outcome"))), 3)


_BUSY = """WITH e AS (SELECT user_id AS root, ts, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'busy' ELSE 'idle' END AS status FROM events), x AS (SELECT *, lead(ts) OVER (PARTITION BY root ORDER BY ts, seq) AS n, ts + INTERVAL 3 HOUR AS "at" FROM e)
SELECT root, ts AS since, "at" FROM x WHERE status = 'busy' AND "at" <= (SELECT max(ts) - INTERVAL 30 SECOND FROM e) AND (n IS NULL OR "at" < n)"""


def _busy(spark, d):
    return events(spark, d).select(F.col("session").alias("root"), "ts", "seq", F.when(F.col("kind").isin("view", "click"), "busy").otherwise("idle").alias("status"))


@query(_BUSY)
def st8_busy_timeout(spark, d):
    b = _busy(spark, d)
    return t.busy_timeouts(b, as_of=_end(b))


@query(_BUSY)
def st8_busy_timeout_stream(spark, d):
    out = shared_folder(spark, "st8-out")
    t.run_to_end(t.busy_timeouts(_replayed(spark, _busy(spark, d), "ts", "st8")), out, shared_folder(spark, "st8-check"))
    return spark.read.parquet(out)


@query("SELECT DISTINCT event_type AS topic, user_id::VARCHAR AS key FROM events")
def st9_dedup_stream(spark, d):
    e = table(spark, d, "events").select("ts", F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"))
    src, out = t.as_stream(e, shared_folder(spark, "st9"), "ts"), shared_folder(spark, "st9-out")
    t.run_to_end(t.deduplicated(src, "60 days"), out, shared_folder(spark, "st9-check"))
    return spark.read.parquet(out).select("topic", "key")


@query(f"WITH {_E} SELECT session, max(ts) AS beat, epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max(ts)) > 15000000 AS stale FROM e GROUP BY 1")
def st10_liveness(spark, d):
    return t.stale(events(spark, d), "session", "2024-01-30 12:00:00", 15)


_ST11 = "WITH i AS (SELECT l_suppkey AS session, l_orderkey AS seq, list(DISTINCT {'c': 'c' || l_partkey % 6, 's': ['completed', 'in_progress', 'cancelled'][l_partkey % 3 + 1]}) AS items FROM lineitem GROUP BY 1, 2), l AS (SELECT session, arg_max(items, seq) AS items FROM i GROUP BY 1) SELECT session, len(list_filter(items, lambda x: x.s = 'completed'))::INT AS done, len(list_filter(items, lambda x: x.s <> 'cancelled'))::INT AS total, list_min(list_transform(list_filter(items, lambda x: x.s = 'in_progress'), lambda x: x.c)) AS current FROM l"


def _lists(spark, d):
    item = F.struct(F.concat(F.lit("c"), F.col("l_partkey") % 6).alias("content"), F.element_at(F.array(*map(F.lit, ("completed", "in_progress", "cancelled"))), (F.col("l_partkey") % 3 + 1).cast("int")).alias("status"))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("session"), F.col("l_orderkey").alias("seq")).agg(F.collect_set(item).alias("items"))


@query(_ST11)
def st11_todo_progress(spark, d):
    return t.todo_progress(_lists(spark, d))


@query(_ST11)
def st11_todo_progress_stream(spark, d):
    out = shared_folder(spark, "st11-out")
    t.latest_table(t.todo_progress(_replayed(spark, _lists(spark, d), "seq", "st11")), out, shared_folder(spark, "st11-check"))
    return spark.read.parquet(out)


@query(f"WITH {_E} SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, instance, count(*)::BIGINT AS events, count(*) FILTER (kind = 'error' AND NOT aborted)::BIGINT AS errors FROM e GROUP BY 1, 2")
def st12_event_counts(spark, d):
    return t.event_counts(events(spark, d))


_ST13 = f"WITH {_E}, a AS (SELECT *, 'a' || seq % 3 AS agent, lag('a' || seq % 3) OVER (PARTITION BY session ORDER BY ts, seq) AS was FROM e) SELECT session, seq, agent, was FROM a WHERE was <> agent"


def _agents(spark, d):
    return events(spark, d).withColumn("agent", F.concat(F.lit("a"), F.col("seq") % 3))


@query(_ST13)
def st13_agent_changes(spark, d):
    return t.agent_changes(_agents(spark, d))


@query(_ST13)
def st13_agent_changes_stream(spark, d):
    out = shared_folder(spark, "st13-out")
    t.run_to_end(t.agent_changes(_replayed(spark, _agents(spark, d), "ts", "st13")), out, shared_folder(spark, "st13-check"))
    return spark.read.parquet(out)


def _late(spark, d):
    """Events by id in batches of a fifth of them, so that many come late."""
    e = table(spark, d, "events").select("event_id", "ts")
    n = e.count()
    return e.withColumn("batch", F.floor(F.col("event_id") * 5 / n).cast("long")), n


#: The largest time before the batch that went before (a stream drops by the watermark that its last batch had).
_LATE = "WITH b AS (SELECT ts, event_id * 5 // (SELECT count(*) FROM events) AS b FROM events), m AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING) AS seen FROM b GROUP BY b) SELECT count(*) FILTER (epoch_us(ts) <= epoch_us(seen) // 1000 * 1000 - {delay})::BIGINT AS late, count(*)::BIGINT AS n FROM b JOIN m USING (b)"


@query(_LATE.format(n=1, delay=86400000000))
def st14_late_rows(spark, d):
    e, _ = _late(spark, d)
    ends = e.groupBy("batch").agg(F.max("ts").alias("m")).withColumn("seen", F.max("m").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)))  # one row a batch
    return t.late_rows(e.join(F.broadcast(ends.select("batch", "seen")), "batch"), F.col("seen"), 86400).agg(F.count_if("late").alias("late"), F.count("*").alias("n"))


@query(_LATE.format(n=2, delay=86400000000))
def st14_late_rows_stream(spark, d):
    """Counted by a listener while the stream runs; one micro-batch a file."""
    e, _ = _late(spark, d)
    src, seen = _replayed(spark, e, "batch", "st14", 5), t.LateRows()
    spark.streams.addListener(seen)
    try:
        t.run_to_end(t.counted(src, "event_id", "1 day"), shared_folder(spark, "st14-out"), shared_folder(spark, "st14-check"))
        for _ in range(100):  # listeners hear of the end a little later
            if seen.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    return spark.createDataFrame([(seen.late, seen.rows)], "late long, n long")


@query("WITH g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, false))::INT AS n FROM events)) SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 6 HOUR AS until, count(*)::BIGINT AS n FROM g GROUP BY user_id, g")
def st15_activity(spark, d):
    return t.activity(table(spark, d, "events"), "user_id")


@query(f"WITH {_CAL} SELECT id, minutes::INT AS minutes, \"start\" - to_minutes(minutes::INT) AS at FROM (SELECT *, unnest(CASE WHEN event_type = 'purchase' THEN [15, 5, 1] ELSE [5, 1] END) AS minutes FROM c)")
def st16_alerts(spark, d):
    c = calendar(spark, d).withColumn("place", F.when(F.col("event_type") == "purchase", "room"))
    return t.alerts(c)


@query("SELECT event_type AS type, event_id, user_id FROM events WHERE event_id % 10 <> 3")
def io4_event_stream(spark, d):
    e = table(spark, d, "events")
    good = F.to_json(F.struct(F.col("event_type").alias("type"), "event_id", "user_id"))
    folder, out = shared_folder(spark, "io4"), shared_folder(spark, "io4-out")
    e.select(F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(good).alias("value")).repartition(3).write.text(folder)
    t.run_to_end(files.decode_events(files.follow(spark, folder), "type string, event_id long, user_id long"), out, shared_folder(spark, "io4-check"))
    return spark.read.parquet(out)


@query("SELECT count(*)::BIGINT AS n FROM events")
def io5_log_follow(spark, d):
    folder, out = shared_folder(spark, "io5"), shared_folder(spark, "io5-out")
    table(spark, d, "events").select(F.concat_ws(" ", F.lit("INFO"), F.col("event_id").cast("string")).alias("value")).repartition(4).write.text(folder)
    t.run_to_end(files.follow(spark, folder), out, shared_folder(spark, "io5-check"))
    return spark.read.parquet(out).agg(F.count("*").alias("n"))


@query(f"{_USAGE} HAVING time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 10 SECOND <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e)")
def io10_usage_sink(spark, d):
    """Windows that the watermark has closed, appended to Parquet files."""
    src, out = t.as_stream(events(spark, d), shared_folder(spark, "io10"), "ts"), shared_folder(spark, "io10-out")
    t.run_to_end(t.usage(src, late="1 hour"), out, shared_folder(spark, "io10-check"))
    return spark.read.parquet(out)
