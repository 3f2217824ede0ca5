"""Queries that run a stream over the events table to its end and give its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.plans.q_graph import MEM_EVENTS
from recallgrid.plans.registry import query
from recallgrid.plans.views import micros
from recallgrid.session import shared_dir
from recallgrid.streaming import live as L


def _events(spark, sf):
    return L.read_events(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))



def _back(df, *times):
    """Times as seconds since 1970 of the table's clock (the stream's times are in the session's zone)."""
    for t in times:
        df = df.withColumn(t, micros(t) / 1000000)
    return df


@query("SELECT epoch_us(time_bucket(INTERVAL '1 minute', ts)) / 1000000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_minute_counts(spark, sf):
    last = lambda d: d.groupBy("start", "event_type").agg(F.max("n").alias("n"))  # noqa: E731  # counts only grow
    return _back(L.drain(L.minute_counts(_events(spark, sf), "event_type"), shared_dir(spark), "update", last), "start")


@query("SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) / 1000000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_day_counts(spark, sf):
    return _back(L.drain(L.minute_counts(_events(spark, sf), "event_type", span="1 day"), shared_dir(spark), "complete"), "start")


@query("WITH w AS (SELECT event_type, epoch_us(time_bucket(INTERVAL '1 minute', ts)) / 1000000 - 60 * k AS start FROM events, range(0, 15) r(k)) SELECT start, event_type, count(*) AS velocity FROM w GROUP BY 1, 2")
def stream_trending(spark, sf):
    return _back(L.drain(L.trending(_events(spark, sf), "event_type"), shared_dir(spark), "complete"), "start")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT epoch_us(min(ts)) / 1000000 AS start, epoch_us(max(ts)) / 1000000 + 1800 AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    return _back(L.drain(L.sessions(_events(spark, sf), "user_id", gap="30 minutes"), shared_dir(spark), "complete"), "start", "end")


@query(f"""WITH mem AS ({MEM_EVENTS}), w AS (SELECT *, lag(memory_id) OVER o AS pm, lag(created_at) OVER o AS pt, lag(cues) OVER o AS pc FROM mem WINDOW o AS (PARTITION BY user_id ORDER BY created_at, seq))
SELECT memory_id, CASE WHEN created_at - pt < 300 AND len(list_intersect(list_distinct(cues), pc)) / greatest(len(cues), 1) > 0.5 THEN 'episode:' || pm END AS episode FROM w""")
def stream_episodes(spark, sf):
    e = L.read_events(spark, sf, "events.parquet")
    cues = F.array(F.concat(F.lit("type:"), "event_type"), F.concat(F.lit("user:"), "user_id"), F.concat(F.lit("k:"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))))
    one = e.select("user_id", F.concat(F.lit("ev:"), "event_id").alias("memory_id"), (micros("ts") / 1e6).alias("seconds"), F.col("event_id").alias("ord"), cues.alias("cues"))
    return L.drain(L.episodes(one, "user_id"), shared_dir(spark), "append")


@query("""WITH l AS (SELECT user_id, list(abs(coalesce(value, 0.0)) / 100 ORDER BY epoch_us(ts), event_id) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, v), lambda a, b: a + b / (1 + a)), 6) AS dynamic_salience, n AS reinforcement_count FROM l""")
def stream_reinforcement(spark, sf):
    e = L.read_events(spark, sf, "events.parquet")
    one = e.select("user_id", (micros("ts") / 1e6).alias("seconds"), F.col("event_id").alias("ord"), (F.abs(F.coalesce("value", F.lit(0.0))) / 100).alias("amount"))
    out = L.drain(L.reinforced(one, "user_id"), shared_dir(spark), "update")
    last = out.groupBy("user_id").agg(F.max_by("dynamic_salience", "reinforcement_count").alias("d"), F.max("reinforcement_count").alias("reinforcement_count"))
    return last.select("user_id", F.round("d", 6).alias("dynamic_salience"), "reinforcement_count")
