"""Streaming versions of feedback insights and first-seen filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.annotate import RATINGS


def windowed_feedback(events: DataFrame, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window, stage and the counts by rating, over a stream or a table; rows later than ``late`` are left out of a stream's windows."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.window(time, window).alias("window"), F.coalesce("stage", F.lit("overall")).alias("stage"))
    return g.agg(*[F.count_if(F.col("rating") == r).alias(r) for r in RATINGS], F.count(F.lit(1)).alias("total"))


def first_seen(rows: DataFrame, keys: list[str], time: str = "ts", late: str = "2 days") -> DataFrame:
    """Rows whose key hasn't been seen before: in a stream within the watermark, in a table one row per key, the earliest."""
    if rows.isStreaming:
        return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), time).alias("r"))
    return one.select("r.*")


def unseen(rows: DataFrame, stream_file: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an append log doesn't hold yet."""
    return rows.join(stream_file.select(*keys).distinct(), keys, "left_anti")
