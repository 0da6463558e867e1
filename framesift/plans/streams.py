"""Queries of streams: a stream over the whole events table, drained into a table."""

from __future__ import annotations

import tempfile


from framesift.plans.common import EV
from framesift.streaming import packets as P


def _folder(spark) -> str:
    """The session's shared folder; a temporary one only where none is set and all runs on one machine."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="framesift-stream-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def stream_tumbling(spark, sf):
    events = P.read_events(spark, f"{sf}/events.parquet")
    return P.drained(P.blocks(events, "1 hour"), spark, _folder(spark))


def stream_sliding(spark, sf):
    events = P.read_events(spark, f"{sf}/events.parquet")
    return P.drained(P.blocks(events, "2 hours", "1 hour"), spark, _folder(spark))


def stream_decode(spark, sf):
    events = P.read_events(spark, f"{sf}/events.parquet")
    return P.drained(P.decoded(events), spark, _folder(spark)).select("user_id", "event_id", "sample", "residual")


def stream_interleave(spark, sf):
    events = P.read_events(spark, f"{sf}/events.parquet")
    return P.drained(P.interleaved(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), apart="12 hours"), spark, _folder(spark))


def stream_dedup(spark, sf):
    """The stream brings every packet twice."""
    twice = P.read_events(spark, f"{sf}/events.parquet").unionByName(P.read_events(spark, f"{sf}/events.parquet"))
    return P.drained(P.distinct_packets(twice), spark, _folder(spark)).select("event_id", "user_id", "x")


HOUR = "epoch_us(ts) // 3600000000 * 3600"
SQL = {
    "stream_tumbling": f"""
        SELECT user_id, CAST({HOUR} AS BIGINT) AS start, count(*) AS n, CAST(sum(x) AS BIGINT) AS s FROM {EV}
        GROUP BY 1, 2 HAVING (start + 3600) * 1000000 <= (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events)
    """,
    "stream_sliding": f"""
        SELECT user_id, CAST({HOUR} - k * 3600 AS BIGINT) AS start, count(*) AS n, CAST(sum(x) AS BIGINT) AS s FROM {EV}, range(2) r(k)
        GROUP BY 1, 2 HAVING (start + 7200) * 1000000 <= (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events)
    """,
    "stream_decode": f"SELECT user_id, event_id, x AS sample, x - coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS residual FROM {EV}",
    "stream_interleave": """
        SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b
        ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOURS
    """,
    "stream_dedup": f"SELECT event_id, user_id, x FROM {EV}",
}
QUERIES = {name: globals()[name] for name in SQL}
