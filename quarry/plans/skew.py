"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.lineage import broadcast_if_small, materialize

HOT = 50_000  # rows under one key that one task need not hold
SALT = 64


def hot_keys(df: DataFrame, key: str, hot: int | None = None) -> tuple[DataFrame, int]:
    """(key) of more than ``hot`` rows, counted by a partial aggregate, and how many there are."""
    found = materialize(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > (hot or HOT)).select(key), "hot")
    return found, found.count()


def skew_join(left: DataFrame, right: DataFrame, key: str, hot: int | None = None) -> DataFrame:
    """Inner join on ``key``: rows of ``left`` under hot keys are spread over ``SALT`` parts, to each
    of which the few rows of ``right`` with that key are copied; all others join plainly."""
    keys, n = hot_keys(left, key, hot)
    if not n:
        return left.join(right, key)
    keys = broadcast_if_small(keys, n)
    plain = left.join(keys, key, "left_anti").join(right, key)
    salted = left.join(keys, key, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALT)).cast("int"))
    copies = right.join(keys, key, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return plain.unionByName(salted.join(copies, [key, "_salt"]).drop("_salt"))
