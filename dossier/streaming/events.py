"""Structured Streaming forms: windowed counts with late data, duplicates, and review status per request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dossier.operators.safety import TRANSITIONS

WATERMARK = "10 minutes"


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream's watermark needs a timestamp with time zone; a batch keeps its own type."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, width: str = "1 hour", late: str = WATERMARK) -> DataFrame:
    """Counts and sums per window and event type; works on a batch and on a stream. Later events than ``late`` are left out of a stream."""
    return _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def once(events: DataFrame, late: str = WATERMARK) -> DataFrame:
    """Each event_id once within the watermark."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = WATERMARK) -> DataFrame:
    return _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n")


def review_status(actions: DataFrame) -> DataFrame:
    """Status of each request after every batch of its actions (request_id, seq, action): state per request; illegal actions change nothing."""
    step = {(a, b): c for a, b, c in TRANSITIONS}

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, bad = state.get if state.exists else ("PENDING", 0, 0)
        for action in pd.concat(list(batches)).sort_values("seq")["action"]:
            new = step.get((status, action))
            bad += new is None
            n += 1
            status = new or status
        state.update((status, n, bad))
        yield pd.DataFrame({"request_id": [key[0]], "status": [status], "n_actions": [n], "n_illegal": [bad]})

    schema = "request_id long, status string, n_actions long, n_illegal long"
    return actions.groupBy("request_id").applyInPandasWithState(advance, schema, "status string, n long, bad long", "update", GroupStateTimeout.NoTimeout)
