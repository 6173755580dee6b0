"""Stream jobs over ``events``, ``orders`` and ``conversations``, each checked against the batch form in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.functions.storage import fresh_path
from sedge.plans.base import query, t
from sedge.streaming import streams


def events(spark, sf, delay="40 days"):
    return streams.with_time(streams.read_stream(spark, f"{sf}/events.parquet"), "ts", delay)


#: Events arrive in files of one day each, in order of time; rows whose number divides by 17 arrive two days late.
ARRIVAL_SQL = "arrive AS (SELECT *, ts::DATE + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END AS arrived FROM events)"


def daily(spark, sf, columns, late_days=2):
    """The events as a stream of one day per batch, in the order of arrival (files are taken by their time of writing)."""
    path = fresh_path(spark, "arrivals")
    arrived = F.date_add(F.to_date("ts"), F.when(F.col("event_id") % 17 == 0, late_days).otherwise(0))
    rows = t(spark, sf, "events").select(*columns, arrived.alias("arrived")).repartition("arrived")  # one file, and so one batch, per day
    rows.write.partitionBy("arrived").parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    days = sorted(f.getPath().getName() for f in files.listStatus(root) if f.getPath().getName().startswith("arrived="))
    for i, day in enumerate(days):
        for f in files.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{day}")):
            files.setTimes(f.getPath(), 1_700_000_000_000 + 60_000 * i, -1)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_audit_ingest", "SELECT ts::DATE AS day, event_id % 13 = 0 AS quarantined, count(*) AS n FROM events GROUP BY 1, 2")
def stream_audit_ingest(spark, sf):
    rows = streams.read_stream(spark, f"{sf}/events.parquet").withColumn("line", F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(F.col("props")))
    out = streams.ingest(rows, raw="line", schema="k bigint", ts="ts")
    back = streams.run(out, mode="append", name="ingest", partition_by=("day",), batch=lambda df, _: df.withColumn("quarantined", F.col("quarantined") | (F.from_json("line", "k bigint")["k"].isNull())))
    return back.groupBy("day", "quarantined").agg(F.count("*").alias("n"))


@query("stream_event_windows", f"""WITH {ARRIVAL_SQL}, days AS (SELECT arrived, max(ts) AS top FROM arrive GROUP BY 1), m AS (SELECT arrived, max(top) OVER (ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 DAY AS mark, max(top) OVER () - INTERVAL 1 DAY AS closing FROM days),
w AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, value, mark, closing FROM arrive JOIN m USING (arrived))
SELECT window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM w WHERE (mark IS NULL OR window_start + INTERVAL 1 HOUR > mark) AND window_start + INTERVAL 1 HOUR <= closing GROUP BY 1, 2""")
def stream_event_windows(spark, sf):
    """Windows leave the state once the watermark, a day behind, has passed them; rows for windows that had left before their batch began are dropped."""
    rows = streams.with_time(daily(spark, sf, ["event_id", "ts", "event_type", "value"]), "ts", "1 day")
    out = streams.run(streams.event_windows(rows, ts="ts", kind="event_type", value="value", size="1 hour"), mode="append", name="windows")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_sliding_windows", """WITH w AS (SELECT (date_trunc('hour', ts) + to_minutes(15 * (minute(ts) // 15)::INT) - to_minutes(15 * i::INT))::TIMESTAMP AS window_start, event_type FROM events, range(4) r(i))
SELECT window_start, event_type, count(*) AS n FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 3 DAY FROM events) GROUP BY 1, 2""")
def stream_sliding_windows(spark, sf):
    """Each window is written once, when the watermark, three days behind, has passed it; rows two days late still count."""
    rows = streams.with_time(daily(spark, sf, ["event_id", "ts", "event_type", "value"]), "ts", "3 days")
    out = streams.run(streams.event_windows(rows, ts="ts", kind="event_type", value="value", size="1 hour", slide="15 minutes"), mode="append", name="sliding")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("stream_sessions", """
WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s), x AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM r GROUP BY user_id, run)
SELECT * FROM x WHERE session_end <= (SELECT max(ts) - INTERVAL 3 DAY FROM events)""")
def stream_sessions(spark, sf):
    """Sessions leave the state once the watermark, three days behind, has passed their end, so rows two days late still count."""
    rows = streams.with_time(daily(spark, sf, ["event_id", "ts", "user_id"]), "ts", "3 days")
    out = streams.run(streams.sessions(rows, ts="ts", entity="user_id", gap="30 minutes"), mode="append", name="sessions")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("stream_span_join", """
SELECT a.event_id AS start_id, b.event_id AS end_id, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 3) AS seconds FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def stream_span_join(spark, sf):
    starts, ends = events(spark, sf).filter("event_type = 'view'"), events(spark, sf).filter("event_type = 'purchase'")
    return streams.run(streams.span_join(starts, ends, entity="user_id", ts="ts", id="event_id", within="1 HOUR"), mode="append", name="spans")


@query("stream_dedup_ttl", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_ttl(spark, sf):
    return streams.run(streams.dedup_ttl(events(spark, sf), keys=["user_id", "event_type"]), mode="append", name="dedup").select("user_id", "event_type")


@query("stream_dedup_expiry", """
WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, ts FROM events), n AS (SELECT *, min(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 120 MINUTE FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM e),
kept AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY 1, 2 UNION ALL SELECT k.user_id, k.event_type, n.after FROM kept k JOIN n ON k.user_id = n.user_id AND k.event_type = n.event_type AND k.ts = n.ts WHERE n.after IS NOT NULL)
SELECT user_id, event_type, ts FROM kept""")
def stream_dedup_expiry(spark, sf):
    """A key's row counts as a repeat for 120 minutes after the last one kept; then the key comes again."""
    rows = streams.with_time(daily(spark, sf, ["event_id", "ts", "user_id", "event_type"], late_days=0), "ts", "1 hour")
    out = streams.run(streams.first_within(rows, keys=["user_id", "event_type"], ts="ts", id="event_id", life_s=7200), mode="append", name="expiry")
    return out.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_span_timeouts", """
WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), w AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(ts) FROM e)) - INTERVAL 3 DAY AS mark),
m AS (SELECT s.event_id AS start_id, e.event_id AS end_id, round((epoch_us(e.ts) - epoch_us(s.ts)) / 1e6, 3) AS seconds FROM s JOIN e ON s.user_id = e.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 1 HOUR)
SELECT * FROM m UNION ALL SELECT event_id, NULL, NULL FROM s WHERE event_id NOT IN (SELECT start_id FROM m) AND ts + INTERVAL 1 HOUR < (SELECT mark FROM w)
UNION ALL SELECT NULL, event_id, NULL FROM e WHERE event_id NOT IN (SELECT end_id FROM m) AND ts < (SELECT mark FROM w)""")
def stream_span_timeouts(spark, sf):
    """Starts and ends without a partner come out when the watermark, three days behind the slower stream, has passed the hour in which it could come; rows two days late still find theirs."""
    every = streams.with_time(daily(spark, sf, ["event_id", "ts", "user_id", "event_type"]), "ts", "3 days")
    rows = [every.filter(f"event_type = '{kind}'") for kind in ("view", "purchase")]
    return streams.run(streams.span_join(*rows, entity="user_id", ts="ts", id="event_id", within="1 HOUR", unmatched=True), mode="append", name="timeouts")


@query("stream_latest_rows", f"""WITH {ARRIVAL_SQL}, d AS (SELECT DISTINCT arrived AS day FROM arrive), r AS (SELECT day, event_type, event_id, row_number() OVER (PARTITION BY day, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM d JOIN arrive ON arrived <= day)
SELECT day, event_type, nth::INT AS nth, event_id FROM r WHERE nth <= 10""")
def stream_latest_rows(spark, sf):
    """The ten newest events of every type after each day's arrivals, late ones among them."""
    out = streams.latest_rows(daily(spark, sf, ["event_id", "ts", "event_type"]), key="event_type", order=["ts", "event_id"], n=10, name="latest")
    late = F.when(F.col("event_id") % 17 == 0, 2).otherwise(0)
    days = t(spark, sf, "events").select(F.date_add(F.to_date("ts"), late).alias("day")).distinct()  # a batch each, in their order
    days = days.withColumn("batch", F.row_number().over(Window.orderBy("day")) - 1)
    return out.join(F.broadcast(days), "batch").select("day", "event_type", "nth", "event_id")


@query("stream_change_state", "SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS value, count(*) AS n_writes FROM orders GROUP BY 1, 2")
def stream_change_state(spark, sf):
    """Only keys that changed are written per batch; the result is each key's last row."""
    log = streams.read_stream(spark, f"{sf}/orders.parquet", max_files=1)
    updates = streams.run(streams.change_state(log, base="o_custkey", key="o_orderpriority", value="o_orderstatus", order=["o_orderdate", "o_orderkey"]), mode="update", name="state")
    return streams.latest(updates, ["o_custkey", "o_orderpriority"])


@query("stream_change_history", """
WITH o AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus AS v, row_number() OVER w AS n, lag(o_orderstatus) OVER w AS old FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey)),
c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS change_no FROM o WHERE n = 1 OR v <> old) SELECT o_custkey, o_orderpriority, change_no, old AS old_value, v AS new_value, o_orderkey FROM c""")
def stream_change_history(spark, sf):
    """The history of every key; each batch goes on from the keys' last values."""
    log = streams.read_stream(spark, f"{sf}/orders.parquet")
    return streams.run(streams.change_history(log, base="o_custkey", key="o_orderpriority", value="o_orderstatus", order="o_orderkey"), mode="append", name="history")


@query("stream_feedback_counts", "SELECT role, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY 1")
def stream_feedback_counts(spark, sf):
    rows = streams.read_stream(spark, f"{sf}/conversations.parquet")
    return streams.run(rows.groupBy("role").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn")), mode="complete", name="feedback")


@query("stream_static_enrich", "SELECT event_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' END AS risk_class FROM events WHERE event_type IN ('error', 'purchase')")
def stream_static_enrich(spark, sf):
    dim = spark.createDataFrame([("error", "high"), ("purchase", "medium")], "event_type string, risk_class string")
    return streams.run(streams.read_stream(spark, f"{sf}/events.parquet").join(F.broadcast(dim), "event_type").select("event_id", "risk_class"), mode="append", name="enrich")


@query("stream_late_rows", f"""WITH {ARRIVAL_SQL}, m AS (SELECT arrived, max(max(ts)) OVER (ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM arrive GROUP BY 1)
SELECT event_id, coalesce(ts < top - INTERVAL 1 DAY, false) AS late FROM arrive JOIN m USING (arrived)""")
def stream_late_rows(spark, sf):
    return streams.late_rows(daily(spark, sf, ["event_id", "ts"]), ts="ts", delay_s=86_400, name="late").select("event_id", "late")
