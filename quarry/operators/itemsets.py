"""Frequent itemsets and association rules over baskets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.lineage import broadcast_if_small, materialize
from quarry.plans.numbering import numbered

BASKETS = 64  # occurrences in a block that the threshold's share of it stands for at least
BLOCK_ROWS = 4_000_000  # pairs in a block, and
BLOCK_BITS = 1 << 31  # bits of its item rows
MAX_CANDIDATES = 2_000_000  # itemsets, broadcast to be counted: 16 bytes and 4 an item each
DIGIT = 16  # bits of a mask that one sequence enumerates


def item_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("item").agg(F.count("*").alias("n"))


def item_dictionary(pairs: DataFrame) -> DataFrame:
    """(item, n, code): items by falling count, ties by item, coded from 1. One row an item."""
    return numbered(item_counts(pairs), [F.desc("n"), "item"], "code", 1).withColumn("code", F.col("code").cast("int"))


def encoded(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(tid, code): pairs with items as codes of the dictionary."""
    return pairs.join(dictionary.select("item", "code"), "item").select("tid", "code")


def decoded(itemsets: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(items, freq): itemsets of codes as sorted items."""
    rows = itemsets.select(F.col("items").alias("codes"), F.explode("items").alias("code"), "freq")
    return rows.join(dictionary.select("code", "item"), "code").groupBy("codes", "freq").agg(F.sort_array(F.collect_list("item")).alias("items")).select("items", "freq")


def frequent_pairs(pairs: DataFrame, min_supp: int) -> DataFrame:
    """Pairs whose item is in at least ``min_supp`` transactions."""
    return pairs.join(item_counts(pairs).where(F.col("n") >= min_supp).select("item"), "item", "left_semi").select("tid", "item")


def n_transactions(pairs: DataFrame) -> int:
    return pairs.select("tid").distinct().count()


def _mined(size: np.ndarray, value: np.ndarray, need: float) -> tuple[list[tuple[int, ...]], list[int]]:
    """All itemsets in at least ``need`` of the baskets of a block, and their counts.

    Each item's baskets are a row of bits. Depth first, a set's row meets those of its possible
    further items in one AND, and only what is frequent goes deeper."""
    basket = np.repeat(np.arange(len(size)), size)
    names, code = np.unique(value, return_inverse=True)
    n = np.bincount(code, minlength=len(names))
    hot = np.flatnonzero(n >= need)
    rows = _bit_rows(basket, code, hot, len(names), len(size))
    names, n = names[hot], n[hot]
    found = [(int(x),) for x in names]
    counts = n.tolist()
    stack = [((), names, rows)]
    while stack:
        head, ext, bits = stack.pop()
        for i in range(len(ext) - 1):
            both = bits[i + 1 :] & bits[i]
            c = np.bitwise_count(both).sum(1, dtype=np.int64)
            keep = np.flatnonzero(c >= need)
            if len(keep):
                items, more = (*head, int(ext[i])), ext[i + 1 :][keep]
                found += [(*items, x) for x in more.tolist()]
                counts += c[keep].tolist()
                if len(keep) > 1:
                    stack.append((items, more, both[keep]))
    return found, counts


def _bit_rows(basket: np.ndarray, code: np.ndarray, hot: np.ndarray, n_codes: int, n_baskets: int) -> np.ndarray:
    """One packed row of bits, a bit a basket, for each code of ``hot``."""
    slot = np.full(n_codes, -1)
    slot[hot] = np.arange(len(hot))
    mine = slot[code] >= 0
    at, b = slot[code[mine]], basket[mine]
    out = np.zeros((len(hot), -(-n_baskets // 64) * 8), np.uint8)
    np.bitwise_or.at(out, (at, b >> 3), (1 << (b & 7)).astype(np.uint8))
    return out.view(np.uint64)


def _counted(size: np.ndarray, value: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Baskets of the block that hold each candidate; candidates come in lexicographic order, so
    each meets only the items it does not share with the one before."""
    basket = np.repeat(np.arange(len(size)), size)
    names, code = np.unique(value, return_inverse=True)
    wanted = np.unique(flat)
    hot = np.flatnonzero(np.isin(names, wanted))
    rows = _bit_rows(basket, code, hot, len(names), len(size))
    none = np.zeros(rows.shape[1], np.uint64)
    where = dict(zip(names[hot].tolist(), range(len(hot))))
    out, path, start = np.zeros(len(ends), np.int64), [], 0
    flat_list = flat.tolist()
    for k, end in enumerate(ends.tolist()):
        items = flat_list[start:end]
        same = 0
        while same < len(path) and same < len(items) and path[same][0] == items[same]:
            same += 1
        del path[same:]
        for x in items[same:]:
            row = rows[where[x]] if x in where else none
            path.append((x, row & path[-1][1] if path else row))
        out[k] = np.bitwise_count(path[-1][1]).sum()
        start = end
    return out


def _by_block(sets: DataFrame, work, schema: str) -> DataFrame:
    """``work(sizes, values)`` once for each partition of baskets, which the caller made even."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, values = [], []
        for b in batches:
            items = b.column("items")
            sizes.append(np.diff(items.offsets.to_numpy()))
            values.append(items.flatten().to_numpy(zero_copy_only=False))
        if sizes and sum(map(len, sizes)):
            yield work(np.concatenate(sizes), np.concatenate(values))

    return sets.select("items").mapInArrow(run, schema)


def frequent_itemsets(pairs: DataFrame, min_supp: int) -> DataFrame:
    """(items, freq): all itemsets of any size in at least ``min_supp`` transactions.

    Infrequent items leave before baskets are formed. Blocks of whole baskets are mined apart: a
    set that is frequent in all is, in some block, at least as frequent for its size, so the
    union of the blocks' own sets misses none; a second pass counts them in every block. A block
    has to be large enough for its threshold to mean something (``BASKETS``). Where that makes
    it too large for a task, or the candidates too many for a broadcast, FP-growth takes over,
    with the fraction half a transaction below the threshold, so rounding cannot move it."""
    counts = materialize(item_counts(pairs).where(F.col("n") >= min_supp), "counts")
    got = counts.agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if not got["items"]:
        return pairs.sparkSession.createDataFrame([], "items ARRAY<INT>, freq BIGINT")
    kept = pairs.join(broadcast_if_small(counts.select("item"), got["items"]), "item", "left_semi").select("tid", "item")
    total = n_transactions(kept)
    share = min_supp / total
    blocks = max(1, int(min(total * share / BASKETS, got["rows"] / (BLOCK_ROWS / 4))))
    fits = got["rows"] / blocks <= BLOCK_ROWS and got["items"] * (total / blocks) <= BLOCK_BITS
    # baskets of one block are even by the hash of their ids, and grouping reuses that partitioning
    spread = kept.repartition(blocks, "tid") if fits else kept
    b = materialize(spread.groupBy("tid").agg(F.collect_set("item").alias("items")).select("tid", "items"), "baskets")
    if fits:
        even = b.repartition(blocks, "tid") if blocks > 1 else b.coalesce(1)
        names = ["items", "n"]

        def mine(size: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            found, n = _mined(size, value, min_supp * len(size) / total - 1e-6)
            return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(n, pa.int64())], names)

        local = materialize(_by_block(even, mine, "items ARRAY<INT>, n BIGINT"), "local")
        if blocks == 1:
            return local.where(F.col("n") >= min_supp).select("items", F.col("n").alias("freq"))
        candidates = local.select("items").distinct()
        if candidates.count() <= MAX_CANDIDATES:
            wide = candidates.orderBy("items").toPandas()["items"]
            shared = pairs.sparkSession.sparkContext.broadcast((np.concatenate(wide.tolist()), np.cumsum(wide.map(len).to_numpy())))

            def count(size: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
                n = _counted(size, value, *shared.value)
                at = np.flatnonzero(n)
                flat, ends = shared.value
                starts = np.concatenate([[0], ends[:-1]])
                return pa.RecordBatch.from_arrays([pa.array([flat[starts[i] : ends[i]] for i in at], pa.list_(pa.int32())), pa.array(n[at])], names)

            sums = _by_block(even, count, "items ARRAY<INT>, n BIGINT").groupBy("items").agg(F.sum("n").alias("freq"))
            return sums.where(F.col("freq") >= min_supp)
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, got["items"] // 1000)
    model = FPGrowth(itemsCol="items", minSupport=max(min_supp - 0.5, 0.5) / total, numPartitions=parts).fit(b.select("items"))
    return model.freqItemsets.select(F.sort_array("items").alias("items"), F.col("freq"))


def rule_splits(itemsets: DataFrame) -> DataFrame:
    """(items, freq, lhs, rhs): every split of an itemset into two non-empty parts, by bit mask.

    Masks are enumerated in digits of ``DIGIT`` bits, so no sequence is longer than 65,536 however
    large the set. A set of more than 62 items has more splits than a mask can number, and raises."""
    size = F.size("items")
    most = F.when(size > 62, F.raise_error(F.lit("an itemset of more than 62 items has too many splits")).cast("int")).otherwise(size)
    masks = itemsets.where(size > 1).withColumn("_size", most).withColumn("mask", F.lit(0).cast("bigint"))
    for low in range(0, 62, DIGIT):
        bits = F.least(F.greatest(F.col("_size") - low, F.lit(0)), F.lit(DIGIT))
        masks = masks.withColumn("_d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2), bits).cast("bigint") - 1)))
        masks = masks.withColumn("mask", F.col("mask") + F.shiftleft(F.col("_d"), low)).drop("_d")
    masks = masks.where("mask > 0").where(F.col("mask") < F.pow(F.lit(2), F.col("_size")).cast("bigint") - 1)
    rhs = F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 1)")
    return masks.withColumn("rhs", rhs).withColumn("lhs", F.array_except("items", "rhs")).select("items", "freq", "lhs", "rhs")


def association_rules(itemsets: DataFrame, min_conf: float) -> DataFrame:
    """(lhs, rhs, support, confidence): rules with any size of either side and a confidence
    strictly above ``min_conf``; the left side's support comes from a join on the itemset."""
    lhs = itemsets.select(F.col("items").alias("lhs"), F.col("freq").alias("lhs_freq"))
    got = rule_splits(itemsets).join(lhs, "lhs").withColumn("confidence", F.col("freq") / F.col("lhs_freq"))
    return got.where(F.col("confidence") > min_conf).select("lhs", "rhs", F.col("freq").alias("support"), "confidence")


def support_listing(itemsets: DataFrame) -> DataFrame:
    """Itemsets in the shape of rules: empty right side, confidence -1."""
    return itemsets.select(F.col("items").alias("lhs"), F.array().cast("array<int>").alias("rhs"), F.col("freq").alias("support"), F.lit(-1.0).alias("confidence"))


def rules_or_listing(itemsets: DataFrame, min_supp: int, min_conf: float, gate: int = 20) -> DataFrame:
    """Rules when the support threshold is above ``gate``, else the plain listing."""
    return association_rules(itemsets, min_conf) if min_supp > gate else support_listing(itemsets)


def join_candidates(itemsets: DataFrame) -> DataFrame:
    """(items): unions of two itemsets of one size that share all but their last item."""
    s = itemsets.select("items", F.expr("slice(items, 1, size(items) - 1)").alias("head"), F.element_at("items", -1).alias("tail"))
    a, b = s.select("head", F.col("tail").alias("x")), s.select("head", F.col("tail").alias("y"))
    return a.join(b, "head").where("x < y").select(F.concat("head", F.array("x", "y")).alias("items"))
