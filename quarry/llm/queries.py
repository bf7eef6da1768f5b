"""Registered queries of the problems tagged llm, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import clusters, leaks, mixing, pairs, reading, terms, vectors
from quarry.llm.oracles import SQL  # noqa: F401
from quarry.plans.lineage import materialize


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")]


def p1_found(s: SparkSession, d: str) -> DataFrame:
    near = vectors.similar_vectors(_t(s, d, "dense_labelled"), _t(s, d, "knn_queries"))
    return near.select(*_pair("query_id", "id")).distinct()


def p1_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Every row with its 10 most similar rows and their labels."""
    return vectors.similar_vectors(_t(s, d, "dense_labelled")).withColumnRenamed("query_id", "id_of").withColumn("d2", F.round("d2", 6))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    got = vectors.cross_split_matches(_t(s, d, "dense_labelled"))
    return vectors.match_pairs(*got).select(*_pair("train_id", "held_out_id")).distinct()


def p3_counts(s: SparkSession, d: str) -> DataFrame:
    return vectors.match_counts(*vectors.cross_split_matches(_t(s, d, "dense_labelled")))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return clusters.similarity_clusters(_t(s, d, "sparse_triplets")).assigned()


def p4_communities(s: SparkSession, d: str) -> DataFrame:
    """Communities inside the groups, with size and most typical documents."""
    return clusters.similarity_clusters(_t(s, d, "sparse_triplets")).described()


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(_t(s, d, "reuters")).where("mark IS NOT NULL").select("term", "mark")


def p5_terms(s: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(_t(s, d, "reuters"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    scored = materialize(terms.distinctive_terms(_t(s, d, "reuters")), "scored")
    return terms.top_by_divergence(scored, 3).select(F.col("rec").alias("newid"), "term")


def p6_top(s: SparkSession, d: str) -> DataFrame:
    """The 3 terms of each article with the largest divergence."""
    scored = terms.distinctive_terms(_t(s, d, "reuters"))
    return terms.top_terms(scored, "divergence", 3, 9).select(F.col("rec").alias("newid"), "term", "rank")


def p6_scores(s: SparkSession, d: str) -> DataFrame:
    """Every term of every article with its divergence score."""
    return terms.distinctive_terms(_t(s, d, "reuters")).drop("len", "cf", "size", "n").withColumnRenamed("rec", "newid").withColumn("divergence", F.round("divergence", 9)).withColumn("tf_idf", F.round("tf_idf", 6))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    got = pairs.cooccurrence(_t(s, d, "baskets"), _t(s, d, "fpt_node"), min_count=5, min_share=1 / 500)
    strong = F.col("n_ab") * F.col("n_baskets") >= 3 * F.col("n_a") * F.col("n_b")
    return got.where((500 * F.col("n_ab") >= F.col("n_baskets")) & strong).select("item_a", "item_b")


def p7_pairs(s: SparkSession, d: str) -> DataFrame:
    """Every two items that share a basket, with their count and lift."""
    return pairs.cooccurrence(_t(s, d, "baskets"), _t(s, d, "fpt_node")).withColumn("lift", F.round("lift", 9))


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_documents(_t(s, d, "documents"), _t(s, d, "eval_items"))


def p8_passages(s: SparkSession, d: str) -> DataFrame:
    """Every leaked passage at its longest, with its place."""
    return leaks.passages(_t(s, d, "documents"), _t(s, d, "eval_items"))


def p8_clean(s: SparkSession, d: str) -> DataFrame:
    """The ids and sources of the documents left when those with leaks are removed."""
    return leaks.remove_leaks(_t(s, d, "documents"), _t(s, d, "eval_items")).select("doc_id", "source")


def p9_mix(s: SparkSession, d: str) -> DataFrame:
    """Every use of a document in the mix, in order of drawing."""
    drawn = mixing.mix_sources(_t(s, d, "documents"), _t(s, d, "mix_targets"))[0]
    return drawn.withColumn("finish_time", F.round("finish_time", 6))


def p9_shares(s: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(_t(s, d, "documents"), _t(s, d, "mix_targets"))[1].withColumn("actual_share", F.round("actual_share", 9))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    """Bands of graded documents: no propagated level can be among them, so none is computed."""
    return reading.bands(reading.grades(_t(s, d, "documents")))


def p10_levels(s: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(_t(s, d, "documents")).withColumn("level", F.round("level", 6))


def p10_ungraded(s: SparkSession, d: str) -> DataFrame:
    """The propagated levels of the documents too short to be graded."""
    levels = reading.reading_levels(_t(s, d, "documents"), tolerance=1e-6)
    return levels.where("NOT graded AND level IS NOT NULL").select("doc_id", F.round("level", 3).alias("level"), "n_words")


def p10_ends(s: SparkSession, d: str) -> DataFrame:
    """The 50 easiest and the 50 hardest documents."""
    levels = reading.reading_levels(_t(s, d, "documents")).where("level IS NOT NULL").select("doc_id", F.round("level", 6).alias("level"))
    low = levels.orderBy("level", "doc_id").limit(50).withColumn("end", F.lit("easy"))
    return low.unionByName(levels.orderBy(F.desc("level"), "doc_id").limit(50).withColumn("end", F.lit("hard")))


QUERIES = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_communities": p4_communities,
    "p5_found": p5_found,
    "p5_terms": p5_terms,
    "p6_found": p6_found,
    "p6_scores": p6_scores,
    "p6_top": p6_top,
    "p7_found": p7_found,
    "p7_pairs": p7_pairs,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p8_clean": p8_clean,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
    "p10_ungraded": p10_ungraded,
    "p10_ends": p10_ends,
}
