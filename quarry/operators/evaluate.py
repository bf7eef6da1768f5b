"""Contingency tables, entropy, purity and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    """(cluster, label, n) of (cluster, label) pairs."""
    return pairs.groupBy("cluster", "label").agg(F.count("*").alias("n"))


def scaled(conf: DataFrame) -> DataFrame:
    """(cluster, label, p): each row of the contingency table as shares."""
    return conf.select("cluster", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))).alias("p"))


def pivoted(conf: DataFrame, labels: list[str]) -> DataFrame:
    """One row a cluster, one column a label, zeros filled in."""
    return conf.groupBy("cluster").pivot("label", labels).agg(F.first("n")).na.fill(0)


def entropy(conf: DataFrame) -> DataFrame:
    """One row: the clusters' label entropies in bits, weighted by size."""
    by = conf.withColumn("s", F.sum("n").over(Window.partitionBy("cluster")))
    p = F.col("n") / F.col("s")
    return by.agg((F.sum(-F.col("n") * F.log2(p)) / F.sum("n")).alias("entropy"))


def purity(conf: DataFrame) -> DataFrame:
    """One row: the share of members that carry their cluster's most common label."""
    return conf.groupBy("cluster").agg(F.max("n").alias("m"), F.sum("n").alias("s")).agg((F.sum("m") / F.sum("s")).alias("purity"))


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
