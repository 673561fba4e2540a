"""Streams, an extension: windows over live events, and leases that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, event_type, n, total`` for tumbling windows; rows later than ``late`` are left out of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "2 days") -> DataFrame:
    """``user_id, start, n``: runs of a user's events with no pause as long as ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


LEASE_SCHEMA = "job bigint, owner string, status string"
_STATE = "owner string, until double"


def leases(claims: DataFrame, seconds: float = 180.0) -> DataFrame:
    """Claims on jobs (``job, owner, at``, a number of seconds) as they are granted, renewed, refused or taken over.

    A lease holds for ``seconds`` from its last renewal; the state is one owner and one time a job.
    """

    def follow(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        owner, until = state.get if state.exists else (None, float("-inf"))
        rows = pd.concat(list(batches)).sort_values(["at", "owner"])
        out = []
        for who, at in zip(rows["owner"], rows["at"], strict=True):
            if owner is None or at >= until:
                status, owner, until = ("granted" if owner is None or owner == who else "reclaimed"), who, at + seconds
            elif who == owner:
                status, until = "renewed", at + seconds
            else:
                status = "refused"
            out.append((key[0], who, status))
        state.update((owner, until))
        yield pd.DataFrame(out, columns=["job", "owner", "status"])

    return claims.groupBy("job").applyInPandasWithState(follow, LEASE_SCHEMA, _STATE, "append", "NoTimeout")
