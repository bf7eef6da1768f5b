"""From articles to weighted sparse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.plans.lineage import broadcast_if_small
from quarry.plans.numbering import numbered


def single_topic(articles: DataFrame) -> DataFrame:
    """(newid, topic, body) of articles with one topic and a body."""
    return articles.where((F.size("topics") == 1) & F.col("body").isNotNull()).select("newid", F.col("topics")[0].alias("topic"), "body")


def topic_counts(single: DataFrame) -> DataFrame:
    return single.groupBy("topic").agg(F.count("*").alias("n"))


def top_topics(single: DataFrame, k: int = 20) -> DataFrame:
    return topic_counts(single).orderBy(F.desc("n"), "topic").limit(k)


def of_top_topics(single: DataFrame, k: int = 20) -> DataFrame:
    """Articles whose topic is among the ``k`` most frequent; ``k`` rows are broadcast."""
    return single.join(F.broadcast(top_topics(single, k).select("topic")), "topic", "left_semi").select("newid", "topic", "body")


def occurrences(docs: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(newid, term): each occurrence of a token that is not a stop word."""
    rows = docs.select("newid", F.explode(fn.tokens(F.col("body"))).alias("term"))
    if stop is None:
        return rows.where(~F.col("term").isin(fn.STOP_WORDS))
    return rows.join(broadcast_if_small(stop.select(F.col("word").alias("term")), stop.count()), "term", "left_anti")


def stem_counts(counts: DataFrame) -> DataFrame:
    """(newid, term, n) by stem: counts of distinct words meet the stems and are added again."""
    words = fn.stem_vocabulary(counts)
    return counts.join(words, "term").groupBy("newid", F.col("stem").alias("term")).agg(F.sum("n").alias("n"))


def term_counts(occ: DataFrame) -> DataFrame:
    return occ.groupBy("newid", "term").agg(F.count("*").alias("n"))


def doc_freq(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(counts: DataFrame, min_df: int = 5) -> DataFrame:
    """(term_id, term, df): terms in at least ``min_df`` documents, numbered from 0 in byte order."""
    kept = doc_freq(counts).where(F.col("df") >= min_df)
    return numbered(kept, ["term"], "term_id").select(F.col("term_id").cast("int").alias("term_id"), "term", "df")


def weighted(counts: DataFrame, vocab: DataFrame, weighting: str = "freq", norm: str = "sumsq") -> DataFrame:
    """(doc_id, dim, val): in-vocabulary counts as f, 1 + sqrt f or 1 + log2 f, divided by the
    document's sum of squares ("sumsq") or by its root ("l2")."""
    n = F.col("n").cast("double")
    forms = {"freq": n, "sqrt": 1 + F.sqrt(n), "log2": 1 + F.log2(n)}
    if weighting not in forms or norm not in ("sumsq", "l2"):
        raise ValueError(f"unknown weighting {weighting!r} or norm {norm!r}")
    w = counts.join(vocab, "term").select(F.col("newid").alias("doc_id"), F.col("term_id").alias("dim"), forms[weighting].alias("w"))
    total = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id"))
    return w.withColumn("t", total if norm == "sumsq" else F.sqrt(total)).select("doc_id", "dim", (F.col("w") / F.col("t")).alias("val"))
