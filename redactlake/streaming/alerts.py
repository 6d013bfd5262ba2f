"""Egress alerts as a stream: counts by window, host and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alert_counts(alerts: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """window start, host, pii_type, total, third_party of alerts (ts, host, pii_type, third); a missing party counts as third.

    Batch or streaming: state is one row a window, host and kind, and goes when the
    watermark has passed the window.
    """
    rows = alerts.withWatermark("ts", late) if alerts.isStreaming else alerts
    out = rows.groupBy(F.window("ts", every).alias("w"), "host", "pii_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("third", F.lit(True))).alias("third_party"))
    return out.select(F.col("w.start").alias("start"), "host", "pii_type", "total", "third_party")
