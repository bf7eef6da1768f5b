"""Dense numbers in a global order, and one row per key, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.lineage import broadcast_if_small, materialize


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name`` = place of the row in the order, from ``start``.

    Rows are range-partitioned and sorted; the driver sees one count per partition and adds each
    partition's offset to the place inside it. The order must have no ties to be defined."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(ranged.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_m", 33)  # monotonic ids: partition above bit 33, place below
    counts = sorted((r["p"], r["n"]) for r in parts.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, at = [], start
    for p, n in counts:
        offsets.append((p, at))
        at += n
    base = df.sparkSession.createDataFrame(offsets, "_p INT, _base BIGINT")  # one row a partition
    placed = parts.withColumn("_p", part.cast("int")).join(F.broadcast(base), "_p")
    return placed.withColumn(name, F.col("_base") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_base")


def one_row_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of ``df``, the smallest value where a key comes more than once.

    Only keys are exchanged to find the repeated ones, and only rows of those are grouped: a wide
    value (a text) of a key that comes once never moves. Null keys are dropped."""
    rows = df.where(F.col(key).isNotNull()).select(key, value)
    again = materialize(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "again")
    n = again.count()
    if not n:
        return rows
    again = broadcast_if_small(again, n)
    merged = rows.join(again, key, "left_semi").groupBy(key).agg(F.min(value).alias(value))
    return rows.join(again, key, "left_anti").unionByName(merged)
