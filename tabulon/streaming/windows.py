"""Event counts over time: one aggregation for batch and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.plans.longform import ref


def event_counts(
    events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "1 day"
) -> DataFrame:
    """Events and value per tumbling window and kind; a stream drops rows later than the watermark."""
    rows = events.withColumn(ts, ref(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    total = F.sum(ref(value))
    grouped = rows.groupBy(F.window(ref(ts), width).alias("w"), ref(kind)).agg(
        F.count(F.lit(1)).alias("events"), F.round(total, 2).alias("total")
    )
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), ref(kind), "events", "total"
    )


def recent_events(events: DataFrame, ts: str, key: str, n: int = 10) -> DataFrame:
    return events.orderBy(F.desc(ts), F.desc(key)).limit(n)


def event_totals(events: DataFrame, kind: str, user: str, value: str) -> DataFrame:
    """Counts, distinct users and value per kind; users are combined per kind first, so a hot kind is spread."""
    per_user = events.groupBy(ref(kind), ref(user)).agg(
        F.count(F.lit(1)).alias("events"), F.sum(ref(value)).alias("total")
    )
    return per_user.groupBy(ref(kind)).agg(
        F.sum("events").alias("events"), F.count(ref(user)).alias("users"), F.round(F.sum("total"), 2).alias("total")
    )
