"""Structured Streaming over the event table's file, compared with the same windows in SQL.

Append-mode windows close when the watermark passes them, so results are held against the windows that a final
far-later row would close: the streams below run in complete or update form over all available input.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.queries import query
from sparkloom.queries.statistics import rounded
from sparkloom.streaming import streams as S

c = F.col


def stream(t):
    """The event file as a stream: the folder of the table, only that file."""
    return S.file_stream(t.spark, t.folder, t.events.schema, glob="events.parquet")


def ntz(df):
    return df.select(*[c(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else c(f.name) for f in df.schema.fields])


@query("stream_append", "SELECT event_id, value FROM events WHERE value > 50")
def _(t):
    return S.drain(stream(t).where("value > 50").select("event_id", "value"))


@query("stream_downsample", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def _(t):
    return ntz(rounded(S.drain(S.downsample(stream(t), "ts", "value", "6 hours", "AVERAGE", ("event_type",)), "complete")))


@query("stream_downsample_others", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, max(value) AS mx, min(value) AS mn, count(*)::DOUBLE AS n FROM events GROUP BY 1")
def _(t):
    parts = [S.downsample(t.events, "ts", "value", "1 day", how).withColumnRenamed("value", n) for how, n in (("MAX", "mx"), ("MIN", "mn"), ("COUNT", "n"))]
    return ntz(parts[0].join(parts[1], "start").join(parts[2], "start"))


@query("stream_every_n", "SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i % 10 = 0")
def _(t):
    return S.every_n(t.events, "ts", 10, ("event_type",), "event_id").select("event_id", "value")


@query("stream_sliding", "SELECT w AS start, round(sum(value), 4) AS value FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS w, value FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1")
def _(t):
    return ntz(rounded(S.drain(S.downsample(stream(t), "ts", "value", "2 hours", "SUM", slide="1 hour"), "complete"), 4))


@query(
    "stream_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
)
def _(t):
    return ntz(S.sessions(t.events, "ts", "12 hours", ("user_id",)))


@query("stream_candles", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2")
def _(t):
    return ntz(S.drain(S.candles(stream(t), "ts", "value", "1 day", ("event_type",), tie="event_id"), "complete"))


@query("stream_running_statistics", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(t):
    d = S.drain(S.running_statistics(stream(t), "value", ("event_type",)), "complete")
    return d.select("event_type", "n", F.round("total", 4).alias("total"), "low", "high", F.round("mean", 6).alias("mean"))


@query("stream_history", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(t):
    return S.history(t.events, "ts", "7 DAYS").select("event_id")


@query(
    "stream_gap_anchored",
    """
    WITH RECURSIVE w AS (SELECT event_type, min(ts) AS start FROM events GROUP BY 1 UNION ALL SELECT w.event_type, (SELECT min(ts) FROM events e WHERE e.event_type = w.event_type AND e.ts >= w.start + INTERVAL 1 HOUR) FROM w WHERE w.start IS NOT NULL),
    s AS (SELECT event_type, start, lead(start) OVER (PARTITION BY event_type ORDER BY start) AS stop FROM w WHERE start IS NOT NULL)
    SELECT s.event_type, start + INTERVAL 30 MINUTE AS label, round(avg(value), 6) AS value, count(*) AS n FROM s JOIN events e ON e.event_type = s.event_type AND e.ts >= start AND (stop IS NULL OR e.ts < stop) GROUP BY s.event_type, start
    """,
)
def _(t):
    return ntz(rounded(S.gap_anchored(t.events, "ts", "value", 3600.0, ("event_type",))))


@query(
    "stream_alarms",
    "WITH w AS (SELECT event_type, ts, value, count(*) OVER p AS n, avg(value) OVER p AS m, stddev_samp(value) OVER p AS s FROM events WINDOW p AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_type, ts, value, round(CASE WHEN s > 0 THEN abs(value - m) / s ELSE 0 END, 6) AS z, coalesce(n >= 10 AND abs(value - m) / s > 2, FALSE) AS alarm FROM w",
)
def _(t):
    return ntz(rounded(S.drain(S.adaptive_alarms(stream(t), "event_type", "ts", "value", 2.0, tie="event_id"))))


@query("stream_incremental_profile", "SELECT count(value) AS value_n, count(*) - count(value) AS value_nulls, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_stddev, min(value) AS value_min, max(value) AS value_max FROM events")
def _(t):
    d = S.drain(S.incremental_profile(stream(t), ["value"]), "complete")
    return d.select("value_n", "value_nulls", F.round("value_mean", 6).alias("value_mean"), F.round("value_stddev", 6).alias("value_stddev"), "value_min", "value_max")


@query("stream_realtime_plot", "SELECT event_type, 'value' AS series, time_bucket(INTERVAL 1 DAY, ts) AS x, round(avg(value), 6) AS value FROM events GROUP BY 1, 3")
def _(t):
    return ntz(rounded(S.realtime_plot(t.events.select("ts", "event_type", "value"), "1 day")))
