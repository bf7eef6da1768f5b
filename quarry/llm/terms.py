"""Term statistics of a collection: dictionary, counts by block, and distinctive terms.

Words of a text: non-ASCII characters are deleted, the rest is lower-cased, everything but
a-z and 0-9 becomes a blank, and empty and all-digit pieces are dropped. Null and wordless
texts have no rows and do not count as records; records repeated under a key count once (the
smallest text of the key stays); null keys are dropped; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.plans.lineage import broadcast_if_small, materialize
from quarry.plans.numbering import numbered

RANGE = 1 << 14  # identifiers in one count array
FLUSH = 2_000_000


def words(text: Column) -> Column:
    """Array of the words of a text."""
    clean = F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\x00-\x7F]", "")), "[^a-z0-9]+", " ")
    return F.filter(F.split(clean, " "), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))


def record_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec, term, tf, len): occurrences of each term in each record, and the record's words.

    The only exchange is on the record key, of whole texts, and the counts reuse its partitioning:
    terms that were counted before an exchange would be several times the texts."""
    one = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("rec")).agg(F.min(F.col(text).cast("string")).alias("text"))
    listed = one.select("rec", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    return listed.select("rec", F.size("ws").alias("len"), F.explode("ws").alias("term")).groupBy("rec", "len", "term").agg(F.count("*").alias("tf")).select("rec", "term", "tf", "len")


def _block_counts(tf: DataFrame) -> DataFrame:
    """(term, occ, recs) of each block of records: one row per block and term."""

    def total(t: pa.Table) -> pa.Table:
        g = t.group_by("term").aggregate([("occ", "sum"), ("recs", "sum")])
        return g.select(["term", "occ_sum", "recs_sum"]).rename_columns(["term", "occ", "recs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            t = pa.table({"term": b.column("term"), "occ": b.column("tf"), "recs": pa.array(np.ones(b.num_rows, np.int64))})
            held.append(t)
            rows += len(t)
            if rows > FLUSH:
                held = [total(pa.concat_tables(held))]
                rows = len(held[0])
                if rows > FLUSH:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from total(pa.concat_tables(held)).to_batches()

    return tf.select("term", "tf").mapInArrow(run, "term STRING, occ BIGINT, recs BIGINT")


def dictionary(terms: DataFrame) -> DataFrame:
    """(term, id): dense identifiers in byte order of the terms."""
    return numbered(terms.distinct(), ["term"], "id")


def _sum_by_range(encoded: DataFrame) -> DataFrame:
    """(id, term, occ, recs) summed: each partition holds whole identifier ranges and adds the
    blocks' counts into one pair of arrays per range, one range at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, occ, recs, names = -1, None, None, None

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(recs)
            return pa.RecordBatch.from_arrays([pa.array(at + now * RANGE), pa.array(names[at], pa.string()), pa.array(occ[at]), pa.array(recs[at])], ["id", "term", "occ", "recs"])

        for b in batches:
            i = b.column("id").to_numpy()
            o, r = b.column("occ").to_numpy(), b.column("recs").to_numpy()
            term = np.array(b.column("term").to_pylist(), object)
            cut = np.flatnonzero(np.diff(i // RANGE)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(i)]):
                if e == s:
                    continue
                if int(i[s]) // RANGE != now:
                    if now >= 0:
                        yield out()
                    now = int(i[s]) // RANGE
                    occ, recs, names = np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64), np.empty(RANGE, object)
                at = i[s:e] - now * RANGE
                np.add.at(occ, at, o[s:e])
                np.add.at(recs, at, r[s:e])
                names[at] = term[s:e]
        if now >= 0:
            yield out()

    by = encoded.withColumn("rng", F.expr(f"id div {RANGE}")).repartition("rng").sortWithinPartitions("rng").drop("rng")
    return by.select("id", "term", "occ", "recs").mapInArrow(run, "id BIGINT, term STRING, occ BIGINT, recs BIGINT")


def term_frequencies(df: DataFrame, key: str = "newid", text: str = "body", rare_below: int = 5, common_share: float = 0.25) -> DataFrame:
    """(term, term_id, n_occurrences, n_records, mark) of every distinct word.

    ``mark`` is ``rare`` below ``rare_below`` records, ``common`` above ``common_share`` of the
    records that have a word, else null; where both hold it is ``rare``."""
    tf = materialize(record_terms(df, key, text), "tf")
    n = tf.select("rec").distinct().count()
    blocks = materialize(_block_counts(tf), "blocks")
    encoded = blocks.join(dictionary(blocks.select("term")), "term")
    mark = F.when(F.col("recs") < rare_below, "rare").when(F.col("recs") > F.lit(common_share * n), "common")
    return _sum_by_range(encoded).select("term", F.col("id").alias("term_id"), F.col("occ").alias("n_occurrences"), F.col("recs").alias("n_records"), mark.alias("mark"))


def distinctive_terms(df: DataFrame, key: str = "newid", text: str = "body", min_records: int = 2, mu: float = 2000.0) -> DataFrame:
    """(rec, term, tf, len, cf, n_records, divergence, tf_idf) of every term that occurs in at least
    ``min_records`` records, with the record's words and the term's occurrences in the
    collection, and the words (``size``) and records (``n``) of the collection.

    ``divergence`` is the term's contribution p(t|d) ln(p(t|d) / p(t|C)) to the relative entropy
    between the record's Dirichlet-smoothed distribution, p(t|d) = (tf + mu p(t|C)) / (len + mu),
    and the collection's p(t|C). ``tf_idf`` is tf ln(N / n_records). A term has at most one row
    a record, so no term is a hot key beyond one row per record."""
    tf = materialize(record_terms(df, key, text), "tf")
    totals = tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"), F.countDistinct("rec").alias("n")).first()
    size, n = float(totals["words"] or 1), float(totals["n"] or 1)
    coll = tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("n_records")).where(F.col("n_records") >= min_records)
    coll = materialize(coll, "terms")  # a counted table: broadcast while it is small
    coll = broadcast_if_small(coll, coll.count())
    p_c = F.col("cf") / size
    p_d = (F.col("tf") + mu * p_c) / (F.col("len") + mu)
    return tf.join(coll, "term").select(
        "rec", "term", "tf", "len", "cf", "n_records", (p_d * F.log(p_d / p_c)).alias("divergence"), (F.col("tf") * F.log(F.lit(n) / F.col("n_records"))).alias("tf_idf"),
        F.lit(size).alias("size"), F.lit(n).alias("n"),
    )


def top_terms(scored: DataFrame, score: str, k: int, digits: int = 6) -> DataFrame:
    """The ``k`` best terms of each record by ``score`` rounded to ``digits`` decimals, then by term."""
    w = Window.partitionBy("rec").orderBy(F.round(score, digits).desc(), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def least_divergence(length: np.ndarray, weight: np.ndarray, size: float, n: float, spread: float, mu: float) -> np.ndarray:
    """A divergence that no term falls short of whose tf ln(N / df) is at least ``weight`` in a record
    of ``length`` words.

    With p = cf / size a term's share of the collection and ``spread`` the largest cf / df, df is at
    least p size / spread, so tf is at least weight / ln(n spread / (size p)), and at least 1. The
    divergence grows with tf from where its ratio is 1 / e. What is left is the smallest value over p,
    taken over intervals of p with the bounds of each."""
    edge = np.geomspace(1 / size, 1.0, 257)
    a, b = edge[:-1], edge[1:]
    room = np.log(np.maximum(n * spread / (size * a), 1.0))
    least = np.full(len(length), np.inf)
    for i in range(0, len(length), 4096):
        w, l = weight[i : i + 4096, None], length[i : i + 4096, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            tf = np.where(w > 0, np.maximum(w / room[None, :], 1.0), 1.0)
            ratio = (tf / b + mu) / (l + mu)
            up = (tf + mu * a) / (l + mu) * np.log(ratio)
            down = np.where(ratio >= 1 / np.e, b * ratio * np.log(ratio), -b / np.e)
        d = np.where(ratio >= 1, up, down)
        d = np.where((tf > l) & (w > 0), np.inf, d)  # more occurrences than words: no such term
        least[i : i + 4096] = np.minimum(d.min(1), least[i : i + 4096])
    return np.where(weight > 0, least, -np.inf)


def top_by_divergence(scored: DataFrame, k: int, mu: float = 2000.0) -> DataFrame:
    """The ``k`` best terms of each record by tf_idf, found by divergence.

    A record's ``k`` terms of largest divergence come first. The smallest tf_idf among them is one the
    k best must reach, and ``least_divergence`` turns it into a divergence they must reach: only the
    terms above that are candidates, and an exact ranking of those follows. None is lost."""
    facts = scored.agg(F.max(F.col("cf") / F.col("n_records")).alias("spread"), F.max("size").alias("size"), F.max("n").alias("n")).first()
    if facts["size"] is None:
        return scored.drop("size", "n").withColumn("rank", F.lit(1))
    size, n, spread = float(facts["size"]), float(facts["n"]), float(facts["spread"])
    first = Window.partitionBy("rec").orderBy(F.desc("divergence"), "term")
    head = scored.select("rec", "term", "len", "divergence", "tf_idf").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    head = head.groupBy("rec", "len").agg(F.min("tf_idf").alias("w"), F.count("*").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = np.where(b.column("c").to_numpy() >= k, b.column("w").to_numpy(zero_copy_only=False) - 1e-6, 0.0)
            least = least_divergence(b.column("len").to_numpy().astype(float), w, size, n, spread, mu)
            yield pa.RecordBatch.from_arrays([b.column("rec"), pa.array(least - 1e-12)], ["rec", "least"])

    floor = materialize(head.mapInArrow(run, "rec BIGINT, least DOUBLE"), "floor")
    floor = broadcast_if_small(floor, floor.count())
    found = scored.drop("size", "n").join(floor, "rec").where("divergence >= least").drop("least")
    return top_terms(found, "tf_idf", k)
