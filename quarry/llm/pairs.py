"""Items that appear together: pair counts and lift by heavy-light decomposition.

Baskets are sets of items with a weight (how many equal baskets the row stands for).
Items in at least one basket of 64 are *heavy*: there are at most 64 times the mean basket
size of them, a bound that does not grow with the data, so their list is broadcast.
Inside a block of whole baskets

* heavy-heavy pairs are popcounts over a packed bit matrix (one word holds 64 baskets),
* heavy-light pairs probe the light items' basket lists into the heavy items' bits,
* light-light pairs are enumerated within baskets and counted by code.

With a minimum count T, items below it are dropped before any exchange (exact: a pair is
never more frequent than its items), and a first pass keeps only pairs that reach their
proportional share of T in at least one block, or among the baskets that are too large for a
block. Every pair that reaches T does so, so the second pass, which counts the kept pairs in all
blocks, loses none. It takes the kept pairs in groups of ``GROUP``, one pass over the blocks each.

Defined results: null baskets, null items and items below ``min_item`` are ignored, lines
repeated in a basket count once, an empty table gives no pairs. A basket with more than
``big`` lines is not gathered into one task: its item chunks are paired as separate groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.lineage import broadcast_if_small, materialize, release

HEAVY = 64
BLOCK_ITEMS = 1_000_000
GROUP = 2_000_000  # candidate pairs counted in one pass, 8 bytes each: a bound that does not grow


def tree_baskets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(baskets, total) of prefix trees: ``baskets`` has (bid, item, w), one row per item of each
    path that ends baskets; ``total`` is one row ``n`` with the roots' counts.

    Paths come from pointer doubling: after round r a node knows its 2**r nearest items, so
    the depth d takes log2(d) joins. Repeated nodes count once (the smallest row of a node_id);
    a node whose parent is missing starts its own path. Parents that form a circle are an error.
    """
    one = nodes.where("node_id IS NOT NULL AND node_count IS NOT NULL").groupBy("node_id").agg(
        F.min(F.struct("parent_id", "item", "node_count")).alias("s")
    ).select("node_id", "s.*")
    one = materialize(one, "nodes")
    total = one.where("parent_id IS NULL").agg(F.coalesce(F.sum("node_count"), F.lit(0)).alias("n"))
    below = one.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("node_count").alias("through"))
    ends = one.join(below, "node_id", "left").select("node_id", (F.col("node_count") - F.coalesce("through", F.lit(0))).alias("w"))
    empty = F.array().cast("array<int>")
    path = one.select(
        "node_id", F.col("parent_id").alias("up"), F.when(F.col("item") >= 1, F.array(F.col("item").cast("int"))).otherwise(empty).alias("items")
    ).join(ends, "node_id")
    path = materialize(path, "path")
    left = one.count().bit_length() + 1  # doublings that the longest path can take
    while path.where("up IS NOT NULL").limit(1).count():
        left -= 1
        if left < 0:
            raise ValueError("the parents of some nodes form a circle")
        last = path
        above = path.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("items").alias("more"))
        path = materialize(
            path.join(above, "up", "left").select("node_id", F.col("up2").alias("up"), F.concat("items", F.coalesce("more", empty)).alias("items"), "w"), "path"
        )
        release(last)
    rows = path.where("w > 0").select(F.col("node_id").alias("bid"), F.explode(F.array_distinct("items")).alias("item"), "w")
    return rows, total


def _count_block(values: np.ndarray, sizes: np.ndarray, weight: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, count), a < b, of one block of baskets given as concatenated distinct items."""
    basket = np.repeat(np.arange(len(sizes)), sizes)
    items, code = np.unique(values, return_inverse=True)
    hot = np.isin(items, heavy)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def emit(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        keep = n > 0
        a, b, n = items[a[keep]], items[b[keep]], n[keep]
        out.append((np.minimum(a, b), np.maximum(a, b), n.astype(np.int64)))

    h = np.flatnonzero(hot)
    if len(h):
        slot = np.full(len(items), -1)
        slot[h] = np.arange(len(h))
        mine = hot[code]
        bits = np.zeros((len(h), len(sizes)), bool)
        bits[slot[code[mine]], basket[mine]] = True
        pad = -len(sizes) % 64
        pack = lambda m: np.packbits(np.pad(m, ((0, 0), (0, pad))), axis=1).view(np.uint64)
        words = pack(bits)
        planes = [(pack(((weight >> j) & 1).astype(bool)[None, :])[0], j) for j in range(int(weight.max()).bit_length())]
        planes = [(p, j) for p, j in planes if p.any()]
        for i in range(len(h) - 1):
            both = words[i + 1 :] & words[i]
            n = sum(np.bitwise_count(both & p).sum(1).astype(np.int64) << j for p, j in planes)
            emit(np.full(len(n), h[i]), h[i + 1 :], n)
        lc, lb = code[~mine], basket[~mine]
        cold = np.flatnonzero(~hot)
        for i in range(len(h)):
            hit = bits[i, lb]
            n = np.bincount(lc[hit], weights=weight[lb[hit]], minlength=len(items))[cold]
            emit(np.full(len(cold), h[i]), cold, n)
        code, basket = lc, lb
    # light-light: pair each item with the s-th after it in its basket, for growing s
    m, w = len(items), weight[basket] if len(basket) else weight[:0]
    unit = bool((weight == 1).all())
    codes, weights, dense = [], [], np.zeros(m * m, np.int64) if m * m <= 1 << 22 else None
    held, s = 0, 1
    at = np.arange(len(code))
    while len(at):
        at = at[at + s < len(code)]
        at = at[basket[at + s] == basket[at]]
        if not len(at):
            break
        x, y = code[at], code[at + s]
        c = np.minimum(x, y) * np.int64(m) + np.maximum(x, y)
        if dense is not None:
            dense += np.bincount(c, minlength=m * m) if unit else np.bincount(c, weights=w[at], minlength=m * m).astype(np.int64)
        else:
            codes.append(c)
            weights.append(w[at])
            held += len(c)
            if held > 8_000_000:
                u, inv = np.unique(np.concatenate(codes), return_inverse=True)
                codes, weights = [u], [np.bincount(inv, weights=np.concatenate(weights)).astype(np.int64)]
                held = len(u)
        s += 1
    if dense is not None:
        c = np.flatnonzero(dense)
        emit(c // m, c % m, dense[c])
    elif codes:
        u, inv = np.unique(np.concatenate(codes), return_inverse=True)
        emit(u // m, u % m, np.bincount(inv, weights=np.concatenate(weights)))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _pair_pass(sets: DataFrame, heavy: np.ndarray, need: int, total: int, kept, singles: bool) -> DataFrame:
    """(item_a, item_b, n) of every block: pairs with n at least ``need / total`` of the block's weight,
    or with a code in the broadcast ``kept``; with ``singles`` also each item's count as (a, a, n)."""

    def rows(sizes: list, values: list, weights: list) -> pa.RecordBatch | None:
        size, value, weight = np.concatenate(sizes), np.concatenate(values).astype(np.int64), np.concatenate(weights)
        if not len(size):
            return None
        a, b, n = _count_block(value, size, weight, heavy)
        if kept is not None:
            code = (a << 32) | b
            wanted = kept.value
            at = np.minimum(np.searchsorted(wanted, code), max(len(wanted) - 1, 0))
            keep = wanted[at] == code if len(wanted) else np.zeros(len(code), bool)
        else:
            least = -(-need * int(weight.sum()) // total)  # in whole numbers: n * total >= need * weight
            keep = n >= least
        a, b, n = a[keep], b[keep], n[keep]
        if singles:
            u, inv = np.unique(value, return_inverse=True)
            c = np.bincount(inv, weights=np.repeat(weight, size)).astype(np.int64)
            a, b, n = np.concatenate([a, u]), np.concatenate([b, u]), np.concatenate([n, c])
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n)], ["item_a", "item_b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, values, weights, held = [], [], [], 0
        for b in batches:
            items = b.column("items")
            sizes.append(np.diff(items.offsets.to_numpy()))
            values.append(items.flatten().to_numpy(zero_copy_only=False))
            weights.append(b.column("w").to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(values[-1])
            if held >= BLOCK_ITEMS:
                if (r := rows(sizes, values, weights)) is not None:
                    yield r
                sizes, values, weights, held = [], [], [], 0
        if sizes and (r := rows(sizes, values, weights)) is not None:
            yield r

    return sets.select("items", "w").mapInArrow(run, "item_a INT, item_b INT, n BIGINT")


def _big_pairs(lines: DataFrame, big_ids: DataFrame) -> DataFrame:
    """(item_a, item_b, n) of baskets too large for one task: their items fall into chunks by
    hash, and every ordered pair of chunks is a join group of its own, so the key of a huge
    basket is spread over n_chunks ** 2 groups; x < y counts each pair once."""
    d = lines.join(big_ids, ["kind", "bid"]).select("kind", "bid", "item", "w", "n_chunks").distinct()
    d = d.withColumn("c", F.pmod(F.xxhash64("item"), F.col("n_chunks")))
    x = d.select("kind", "bid", "w", "c", F.col("item").alias("x"), F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("o"))
    y = d.select("kind", "bid", "n_chunks", F.col("c").alias("o"), F.col("item").alias("y"))
    # (c, o) is one task's worth: the key spreads a basket over n_chunks ** 2 groups
    y = y.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    both = x.join(y.drop("n_chunks"), ["kind", "bid", "c", "o"]).where("x < y")
    return both.groupBy(F.col("x").alias("item_a"), F.col("y").alias("item_b")).agg(F.sum("w").alias("n"))


def cooccurrence(
    baskets: DataFrame,
    nodes: DataFrame | None = None,
    min_count: int = 1,
    min_share: float = 0.0,
    tid: str = "tid",
    item: str = "item",
    min_item: int = 1,
    big: int = 20_000,
) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_baskets, lift) of every pair of items with
    ``n_ab >= min_count`` and ``n_ab >= min_share * n_baskets``."""
    i = F.col(item)
    raw = baskets.where(F.col(tid).isNotNull() & (i >= min_item)).select(
        F.lit(0).alias("kind"), F.col(tid).cast("bigint").alias("bid"), i.cast("int").alias("item"), F.lit(1).cast("bigint").alias("w")
    )
    per = raw.groupBy("kind", "bid").agg(F.count("*").alias("lines"))
    counted = per.agg(F.count("*").alias("n"), F.coalesce(F.max("lines"), F.lit(0)).alias("most")).first()
    total, most = counted["n"], counted["most"]
    lines = raw
    if nodes is not None:
        trees, n = tree_baskets(nodes)
        total += n.first()["n"]
        lines = raw.unionByName(trees.select(F.lit(1).alias("kind"), "bid", "item", "w"))
    need = max(min_count, math.ceil(min_share * total), 1)
    occurs = materialize(lines.groupBy("item").agg(F.sum("w").alias("n")).where(F.col("n") >= need), "occurs")
    stats = occurs.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()
    # lines per basket bound the number of heavy items: at most HEAVY * mean basket size
    heavy = np.array([r["item"] for r in occurs.where(F.col("n") * HEAVY >= total).select("item").collect()], np.int64)
    if need > 1:
        lines = lines.join(broadcast_if_small(occurs.select("item"), stats["n"]), "item", "left_semi")
    large = None
    if most > big and stats["n"] > big:
        sizes = per.where(F.col("lines") > big).select("kind", "bid", F.ceil(F.col("lines") / (big // 4)).alias("n_chunks"))
        sizes = materialize(sizes, "big")
        large = _big_pairs(lines, sizes)
        single = lines.join(sizes, ["kind", "bid"], "left_semi").distinct().groupBy("item").agg(F.sum("w").alias("n"))
        lines = lines.join(sizes, ["kind", "bid"], "left_anti")
    # what is left holds at most ``big`` items in any basket, so gathering a basket is bounded
    sets = lines.groupBy("kind", "bid").agg(F.collect_set("item").alias("items"), F.max("w").alias("w"))
    sets = materialize(sets.select("items", "w"), "sets")
    code = (F.shiftleft(F.col("item_a").cast("bigint"), 32).bitwiseOR(F.col("item_b").cast("bigint"))).alias("code")
    if large is not None:
        large = materialize(large, "large")
        single = materialize(single, "single")
    if need > 1:
        cand = _pair_pass(sets, heavy, need, total, None, False).select(code)
        if large is not None:
            share = -(-need * sizes.count() // total)
            cand = cand.unionByName(large.where(F.col("n") >= share).select(code))
        cand = materialize(cand.distinct(), "candidates")
        groups = max(1, math.ceil(cand.count() / GROUP))
        found = None
        for g in range(groups):
            mine = cand.where(F.pmod(F.xxhash64("code"), F.lit(groups)) == g) if groups > 1 else cand
            kept = baskets.sparkSession.sparkContext.broadcast(np.sort(mine.toPandas()["code"].to_numpy(np.int64)))
            part = materialize(_pair_pass(sets, heavy, need, total, kept, g == 0), "counts")
            kept.destroy()
            found = part if found is None else found.unionByName(part)
        if large is not None:
            large = large.withColumn("code", code).join(cand, "code", "left_semi").drop("code")
    else:
        found = _pair_pass(sets, heavy, 0, 1, None, True)
    if large is not None:
        found = found.unionByName(large).unionByName(single.select(F.col("item").alias("item_a"), F.col("item").alias("item_b"), "n"))
    sums = materialize(found.groupBy("item_a", "item_b").agg(F.sum("n").alias("n_ab")), "sums")
    ones = sums.where("item_a = item_b")
    small = lambda df: broadcast_if_small(df, stats["n"])
    scored = sums.where((F.col("item_a") < F.col("item_b")) & (F.col("n_ab") >= need))
    scored = scored.join(small(ones.select("item_a", F.col("n_ab").alias("n_a"))), "item_a")
    scored = scored.join(small(ones.select("item_b", F.col("n_ab").alias("n_b"))), "item_b")
    return scored.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(total).cast("bigint").alias("n_baskets"), (F.col("n_ab") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b"))).alias("lift")
    )
