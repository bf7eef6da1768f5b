"""Cleaned views of the domain tables; every operator of the library starts from these.

Keys identify rows everywhere: nothing depends on the order of lines in a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.numbering import one_row_per_key


def transactions(df: DataFrame, tid: str = "tid", item: str = "item") -> DataFrame:
    """(tid, item): distinct pairs with a tid and a positive item."""
    return df.where(F.col(tid).isNotNull() & (F.col(item) >= 1)).select(F.col(tid).alias("tid"), F.col(item).alias("item")).distinct()


def baskets(pairs: DataFrame) -> DataFrame:
    """(tid, items): each transaction as a sorted array of distinct items."""
    return pairs.groupBy("tid").agg(F.sort_array(F.collect_set("item")).alias("items"))


def triplets(df: DataFrame, doc: str = "doc_id", dim: str = "dim", val: str = "val") -> DataFrame:
    """(doc_id, dim, val): null values and negative dims dropped, repeated cells once."""
    good = df.where(F.col(doc).isNotNull() & (F.col(dim) >= 0) & F.col(val).isNotNull() & ~F.isnan(val))
    return good.groupBy(F.col(doc).alias("doc_id"), F.col(dim).alias("dim")).agg(F.min(val).alias("val"))


def class_labels(df: DataFrame, doc: str = "doc_id", label: str = "label") -> DataFrame:
    """(doc_id, label): one trimmed lower-case label a document, the smallest where rows differ."""
    t = F.lower(F.trim(F.col(label)))
    return df.where(F.col(doc).isNotNull() & (t != "")).groupBy(F.col(doc).alias("doc_id")).agg(F.min(t).alias("label"))


def assignment(df: DataFrame, doc: str = "doc_id", run: str = "run_no", cluster: str = "cluster_no") -> DataFrame:
    """(doc_id, cluster): each document's cluster in its first run that assigned it."""
    good = df.where(F.col(doc).isNotNull() & F.col(run).isNotNull() & (F.col(cluster) >= 0))
    return good.groupBy(F.col(doc).alias("doc_id")).agg(F.min(F.struct(run, cluster)).alias("s")).select("doc_id", F.col(f"s.{cluster}").alias("cluster"))


def usable(v: Column, dim: int) -> Column:
    return (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def dense_vectors(df: DataFrame, dim: int = 49, vec: str = "features", need: tuple[str, ...] = ("label", "split")) -> DataFrame:
    """(id, label, features, split): usable vectors, one row an id; rows without one of ``need`` are dropped."""
    good = df.where(F.col("id").isNotNull() & usable(F.col(vec), dim)).na.drop(subset=list(need)) if need else df.where(F.col("id").isNotNull() & usable(F.col(vec), dim))
    one = good.groupBy("id").agg(F.min(F.struct("label", F.col(vec).cast("array<double>").alias("features"), "split")).alias("s"))
    return one.select("id", "s.*")


def articles(df: DataFrame) -> DataFrame:
    """(newid, topics, body): one row an article, topics as its distinct non-empty topics. Only the
    rows of articles that come more than once are grouped, so no other body moves."""
    topics = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))))
    one = one_row_per_key(df.select("newid", F.struct(topics.alias("topics"), "body").alias("s")), "newid", "s")
    return one.select("newid", "s.topics", "s.body")
