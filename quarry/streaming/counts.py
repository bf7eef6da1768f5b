"""Item counts over arriving transaction lines, in event-time windows with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_item_counts(lines: DataFrame, window: str = "1 day", late: str = "6 hours", time: str = "read_at") -> DataFrame:
    """(start, item, n) of each window: lines of a positive item with a tid, each (tid, item) of a
    window once. Works on a stream (append mode; lines later than ``late`` are dropped) and on a
    batch table alike; state is bounded by the watermark."""
    good = lines.where(F.col("tid").isNotNull() & (F.col("item") >= 1) & F.col(time).isNotNull())
    if lines.isStreaming:
        good = good.withWatermark(time, late)
    w = good.select(F.window(time, window).alias("w"), "tid", "item").dropDuplicates(["w", "tid", "item"])
    return w.groupBy("w", "item").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "item", "n")
