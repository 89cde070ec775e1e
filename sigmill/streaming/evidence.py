"""Evidence of reports as streams: hourly sessions by chained aggregations, and pairs of a window by an interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_sessions_stream(reports: DataFrame, delay: str = "72 hours") -> DataFrame:
    """(bucket_start, raw_report_count, unique_sessions) of each hour, once, when the watermark has passed it.

    First every session of an hour is one row, keyed by both, so no task holds an hour's sessions; these rows are counted in a
    second aggregation. Late reports count while the watermark allows; reports without a session are no session.
    """
    hour = F.window("received_at", "1 hour")
    sessions = reports.withWatermark("received_at", delay).groupBy(hour, "session_id").agg(F.count("*").alias("n"))
    counted = sessions.groupBy(F.window(F.window_time("window"), "1 hour").alias("hour")).agg(
        F.sum("n").alias("raw_report_count"), F.count("session_id").alias("unique_sessions")
    )
    return counted.select(F.col("hour.start").alias("bucket_start"), "raw_report_count", "unique_sessions")


def window_pairs_stream(left: DataFrame, right: DataFrame, window: int, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Streaming twin of operators.gates.window_pairs: (keys, left_id, right_id, gap).

    left and right are two readings of the same reports (keys, report_id, received_at). Both sides have a watermark and the
    join bounds their distance in time, so a report leaves the state once no other can come within the window of it.
    """
    a = left.select(*keys, F.col("report_id").alias("a"), F.col("received_at").alias("ta")).withWatermark("ta", delay)
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("report_id").alias("b"), F.col("received_at").alias("tb")).withWatermark("tb", delay)
    reach = F.expr(f"INTERVAL {window} SECONDS")
    met = (F.col("tb") >= F.col("ta") - reach) & (F.col("tb") <= F.col("ta") + reach) & (F.col("a") < F.col("b"))
    for k in keys:
        met = met & (F.col(k) == F.col(f"_{k}"))
    gap = F.abs(F.unix_micros("tb") - F.unix_micros("ta")) / 1_000_000
    return a.join(b, met).select(*keys, F.col("a").alias("left_id"), F.col("b").alias("right_id"), gap.alias("gap"))
