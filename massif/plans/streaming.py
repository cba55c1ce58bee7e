"""Windowed counts and gap sessions over events, with the batch form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.runtime import table
from massif.streaming import events as E


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _seconds(df, *columns):
    return df.select(*[F.unix_timestamp(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def stream_sliding_count(spark, sf_dir):
    return _seconds(E.sliding_counts(_events(spark, sf_dir)), "start")


def stream_gap_session(spark, sf_dir):
    return _seconds(E.gap_sessions(_events(spark, sf_dir)), "start").drop("end")


QUERIES = {
    "stream_sliding_count": (
        stream_sliding_count,
        """WITH e AS (SELECT floor(epoch(ts))::BIGINT AS t, event_type, value FROM events), w AS (SELECT unnest([t - t % 1800, t - t % 1800 - 1800]) AS start, event_type, value FROM e)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""",
    ),
    "stream_gap_session": (
        stream_gap_session,
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOURS THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    ),
}
