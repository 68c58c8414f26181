"""Streams over the events table, run until all is read; their results equal the batch queries'."""

from __future__ import annotations

from ..streaming import events as E

STAGES = {"signup": 1, "view": 2, "click": 3, "purchase": 4}
_SEC = "date_diff('second', TIMESTAMP '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP))"


def _stream(spark, sf_dir):
    return E.file_stream(spark, f"{sf_dir}/events.parquet")


def stream_event_tumbling(spark, sf_dir):
    return E.drain(E.windowed(_stream(spark, sf_dir), "6 hours", by=["event_type"]), ["start", "event_type"])


def stream_event_sliding(spark, sf_dir):
    return E.drain(E.windowed(_stream(spark, sf_dir), "6 hours", "3 hours"), ["start"]).select("start", "n")


def stream_user_stage(spark, sf_dir):
    return E.drain(E.stages(_stream(spark, sf_dir), STAGES), ["user_id"])


def stream_log_tail(spark, sf_dir):
    rows = _stream(spark, sf_dir).where("event_id > 900 and event_type = 'error'")
    return E.drain(rows.selectExpr("event_id as seq", "event_type as message"))


QUERIES = {f.__name__: f for f in (stream_event_tumbling, stream_event_sliding, stream_user_stage, stream_log_tail)}

ORACLE_SQL = {
    "stream_event_tumbling": f"SELECT {_SEC} // 21600 * 21600 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_event_sliding": f"SELECT ({_SEC} // 10800 - k) * 10800 AS start, count(*) AS n FROM events, unnest([0, 1]) AS r(k) GROUP BY ALL",
    "stream_user_stage": "SELECT user_id, CAST(max(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) AS INT) AS stage FROM events GROUP BY user_id",
    "stream_log_tail": "SELECT event_id AS seq, event_type AS message FROM events WHERE event_id > 900 AND event_type = 'error'",
}
