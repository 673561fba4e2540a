"""Queries beyond the data model's own: event-time windows and sessions, run here over the whole table at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import streaming
from tidewell.plans.registry import query
from tidewell.plans.views import r, read, rounded


@query("stream_windows", f"SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n, {r('sum(value)', 3)} AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    out = streaming.windowed_counts(read(spark, d, "events"))
    return out.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", rounded(F.col("total"), 3).alias("total"))


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, opens ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch(date_trunc('second', min(ts)))::BIGINT AS start_s, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    out = streaming.sessions(read(spark, d, "events"))
    return out.select("user_id", F.unix_timestamp("start").alias("start_s"), "n")
