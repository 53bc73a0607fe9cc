"""Extension (the reference has no streams): gap sessions over a stream of events, by session windows with a watermark.

A gap equal to the limit stays in the session, as in the batch operator; batch and stream give the same sessions for
events that arrive within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, by: str, ts: str, limit_seconds: int, late: str = "1 hour") -> DataFrame:
    """by, session_start, session_end (last event) and n for each session of the stream."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    sessions = stamped.groupBy(by, F.session_window("_ts", f"{limit_seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.max("_ts").alias("session_end"))
    return sessions.select(by, F.col("w.start").alias("session_start"), "session_end", "n")
