"""Clusters of similar sparse vectors: neighbour descent, components, modularity.

1. Exact copies (equal unit vectors) become one node.
2. Every node emits the pairs of dims of its prefix. With dims ordered from rare to common, the
   prefix ends where the rest together with any one dim of the prefix can no longer reach the
   similarity, so two similar vectors share at least two dims of both prefixes: one emitted
   pair. (A vector in which one dim alone can reach it emits that dim, too.) This is exact. A vector
   of more than ``LONG`` dims would have too many pairs: it emits the single dims of a shorter
   prefix instead, of which it shares at least one with any similar vector, and of the others'
   single dims only those are kept that a long vector emits. Two short ones never meet by them.
3. Nodes that are neighbours in the order of (pair, node) start the graph; neighbour descent
   improves it: neighbours of a node are compared with each other, the best ``k`` are kept.
4. Communities of that graph by modularity: local moving and merging until nothing is gained. A
   community lies within one component of the graph, so it is a part of one group.
5. The exact check ties communities to groups: their links in the graph, then what is left, nodes
   that share a pair of dims but lie in different components of that. No similar pair that would
   join two groups is missed, and the groups need no pair inside one.
   Links, degrees and the described communities do: for those all nodes of one group that share a
   pair of dims are compared, so that every link is found, however few the descent has seen, and
   communities are settled again on all links.

Keys are never all on disk: they are made anew from the prefixes for one range of their hashes after
another, and the pairs found are compared in parts as soon as they take the same room, which follows
the size of the vectors (``ROOM``). What is dropped by then is no longer read.

A 256-bit bitmap of hashed dims prunes comparisons: a node needs at least ``need`` of its buckets
to reach the similarity, so a pair with fewer buckets in common is out. This is exact as well.

Defined results: triplets with null doc, null dim, null or NaN val or negative dim are dropped,
(doc, dim) given more than once counts once (smallest val), a document without a non-zero value
takes no part; an empty table gives no groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.components import components
from quarry.plans.lineage import broadcast_if_small, gathered, materialize, release
from quarry.plans.skew import skew_join

BITS = ["b0", "b1", "b2", "b3"]
LONG = 160
CROWD = 2_000  # nodes or components under one pair of dims that meet in one group
BUCKETS = 1 << 16  # of dims, whose frequency orders them
SINGLE, ALONE = 2**61, 2**62
SLOTS = 1 << 16  # of the keys' hashes
ROOM = 64 << 20  # bytes of keys, pairs or vectors on disk at once, or half as much again as the vectors take
KEY_BYTES, PAIR_BYTES = 64, 24  # about, in a shuffle
APART = 50_000  # links of a component that one task settles


def unit_vectors(triplets: DataFrame, doc: str, dim: str, val: str) -> DataFrame:
    """(doc_id, dims, vals): unit vectors, dims from rare to common (then by number). How common is
    counted in buckets of dims, whose counts any task can hold, so triplets move once, by document."""
    t = triplets.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(dim).cast("bigint").alias("dim"), F.col(val).cast("double").alias("val"))
    t = t.where("doc_id IS NOT NULL AND dim >= 0 AND val IS NOT NULL AND NOT isnan(val) AND val <> 0")
    bucket = F.pmod(F.xxhash64("dim"), F.lit(BUCKETS)).cast("int").alias("bucket")
    df = materialize(t.groupBy(bucket).agg(F.count("*").alias("df")), "df")
    t = t.repartition("doc_id").groupBy("doc_id", "dim").agg(F.min("val").alias("val"))
    v = t.withColumn("bucket", bucket).join(F.broadcast(df), "bucket").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "dim", "val"))).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x["val"] * x["val"]))
    return v.select("doc_id", F.transform("e", lambda x: x["dim"]).alias("dims"), F.transform("e", lambda x: x["val"] / norm).alias("vals"))


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, nodes): each document's copy key, and one node per distinct unit vector, named
    by its smallest doc_id. Values equal to 9 decimals count as equal: far above the similarity."""
    key = F.unhex(F.md5(F.concat_ws(",", F.transform("dims", lambda d: d.cast("string")), F.transform("vals", lambda v: F.round(v * 1e9).cast("bigint").cast("string")))))
    keyed = materialize(vectors.withColumn("key", key), "vectors")
    nodes = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "dims", "vals")).alias("s"), F.count("*").alias("copies"))
    nodes = materialize(nodes.select("key", F.col("s.doc_id").alias("node"), F.col("s.dims").alias("dims"), F.col("s.vals").alias("vals"), "copies"), "nodes")
    members = materialize(keyed.select("doc_id", "key"), "members")
    release(keyed)
    return members, nodes


def _prefix(vals: np.ndarray, t: float, single: bool) -> int:
    """Length of the prefix of step 2."""
    sq = vals * vals
    rest = np.maximum(1 - np.cumsum(sq), 0)
    top = 0.0 if single else np.maximum.accumulate(sq)
    done = np.flatnonzero(rest + top < (t - 1e-6) ** 2)
    return int(done[0]) + 1 if len(done) else len(vals)


def _mix(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    y = np.asarray(y).astype(np.uint64)
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (y * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))).view(np.int64)


def prefix_pairs(dims: np.ndarray, vals: np.ndarray, t: float, single: bool = False) -> np.ndarray:
    """Codes of the dim pairs and single dims a unit vector has to be found by; see step 2."""
    p = _prefix(vals, t, single)
    if single:
        return _mix(dims[:p], SINGLE)
    i, j = np.triu_indices(p, 1)
    return np.concatenate([_mix(dims[i], dims[j]), _mix(dims[np.abs(vals) >= t - 1e-6], ALONE)])


def _slices(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    off = b.column("dims").offsets.to_numpy()
    return b.column("node").to_numpy(), off - off[0], b.column("dims").flatten().to_numpy(), b.column("vals").flatten().to_numpy()


def _heads(nodes: DataFrame, t: float) -> DataFrame:
    """(node, dims, alone, single, long, need, b0..b3): the dims of each node's prefix and how many of
    those make the shorter one, the dims that reach the similarity alone, hashed dims as 256 bits, and
    how many buckets a similar node shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, off, dims, vals = _slices(b)
            slot = ((dims.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
            load = np.bincount(np.repeat(np.arange(len(node)), np.diff(off)) * 256 + slot, weights=vals * vals, minlength=len(node) * 256).reshape(-1, 256)
            bits = np.packbits(load > 0, axis=1, bitorder="little").view(np.int64)
            need = (np.cumsum(-np.sort(-load, axis=1), axis=1) < (t - 1e-6) ** 2).sum(1) + 1
            long = np.diff(off) > LONG
            single = np.array([_prefix(vals[i:j], t, True) for i, j in zip(off[:-1], off[1:])], np.int32)
            size = np.array([s if w else _prefix(vals[i:j], t, False) for i, j, s, w in zip(off[:-1], off[1:], single, long)], np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            head = dims[np.repeat(off[:-1] - ends[:-1], size) + np.arange(ends[-1])]
            heavy = (np.abs(vals) >= t - 1e-6) & ~np.repeat(long, np.diff(off))
            at = np.concatenate([[0], np.cumsum(heavy)])[off]
            cols = [pa.array(node), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(head)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(dims[heavy]))]
            cols += [pa.array(single), pa.array(long), pa.array(need.astype(np.int32)), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "dims", "alone", "single", "long", "need", *BITS])

    schema = "node BIGINT, dims ARRAY<BIGINT>, alone ARRAY<BIGINT>, single INT, long BOOLEAN, need INT, " + ", ".join(f"{b} BIGINT" for b in BITS)
    return nodes.select("node", "dims", "vals").mapInArrow(run, schema)


def _codes(b: pa.RecordBatch, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code) of the prefixes in a batch of heads: 0 pairs and dims alone of short vectors, 1 single
    dims of long ones, 2 of short ones. A piece has some two million codes at most."""
    off, long = b.column("dims").offsets.to_numpy(), b.column("long").to_numpy(zero_copy_only=False)
    dims, off = b.column("dims").flatten().to_numpy(), off - off[0]
    size = b.column("single").to_numpy() if kind else np.diff(off)
    of = np.flatnonzero(long if kind == 1 else ~long)
    if kind:
        row = np.repeat(of, size[of])
        place = np.arange(len(row)) - np.repeat(np.cumsum(size[of]) - size[of], size[of])
        yield row, _mix(dims[off[row] + place], SINGLE)
        return
    row = np.repeat(np.arange(b.num_rows), np.diff(b.column("alone").offsets.to_numpy()))
    yield row, _mix(b.column("alone").flatten().to_numpy(), ALONE)
    for p in np.unique(size[of]):
        i, j = np.triu_indices(p, 1)
        same = of[size[of] == p]
        step = max(1, 2_000_000 // max(1, len(i)))
        for k in range(0, len(same), step):
            part = same[k : k + step]
            m = dims[off[part][:, None] + np.arange(p)]
            yield np.repeat(part, len(i)), _mix(m[:, i], m[:, j]).ravel()


class Keys:
    """The keys (pair, node, kind, ...) by which nodes meet, made anew for each range of hashes, so that
    only a part of them is on disk at a time. Kinds: 0 pairs of short vectors, 1 single dims of long
    ones, 2 single dims of short ones that a long one has as well."""

    def __init__(self, heads: DataFrame, room: int) -> None:
        self.heads, self.room = heads, room
        size = F.size("dims")
        n = F.when(F.col("long"), size).otherwise((size * (size - 1) / 2).cast("bigint") + F.size("alone") + F.col("single"))
        got = heads.agg(F.sum(n).alias("n"), F.max("long").alias("long")).first()
        self.count, self.long = got["n"] or 0, bool(got["long"])
        self.step = max(1, int(SLOTS * min(1, room / max(1, self.count * KEY_BYTES))))
        self.singles = materialize(self._made(heads, 0, SLOTS, 1).select("pair").distinct(), "singles") if self.long else None

    @staticmethod
    def _made(heads: DataFrame, lo: int, hi: int, kind: int) -> DataFrame:
        own = [c for c in ("comp", "need", *BITS) if c in heads.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row, code in _codes(b, kind):
                    slot = (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
                    at = np.flatnonzero((slot >= lo) & (slot < hi))
                    rest = b.select(["node", *own]).take(pa.array(row[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(code[at]), pa.array(np.full(len(at), kind, np.int32)), *rest.columns], ["pair", "kind", "node", *own])

        types = {"comp": "BIGINT", "need": "INT"}
        return heads.mapInArrow(run, "pair BIGINT, kind INT, node BIGINT" + "".join(f", {c} {types.get(c, 'BIGINT')}" for c in own))

    def between(self, heads: DataFrame, lo: int, hi: int) -> DataFrame:
        """The keys of ``heads`` (with more columns, perhaps) whose hashes are in the range."""
        keys = self._made(heads, lo, hi, 0)
        if self.long:
            others = self._made(heads, lo, hi, 2).join(self.singles, "pair", "left_semi")
            keys = keys.unionByName(self._made(heads, lo, hi, 1)).unionByName(others.select(keys.columns))
        return keys

    def each(self, heads: DataFrame, pairs_of: Callable[[DataFrame], DataFrame], out: Compared) -> None:
        """Give ``out`` the pairs of nodes that ``pairs_of`` finds in the keys, range by range. A range is
        smaller where the one before gave more pairs than there is room for."""
        at, step = 0, self.step if self.step == SLOTS else max(1, self.step // 4)
        while at < SLOTS:
            n = out.add(pairs_of(self.between(heads, at, min(SLOTS, at + step))))
            at += step
            step = max(1, min(self.step, 2 * step, step * self.room // max(1, n * PAIR_BYTES)))


class Compared:
    """Pairs of nodes, kept until they take ``room``, then compared in parts and dropped; of those only
    the ones of at least ``floor`` stay."""

    def __init__(self, nodes: DataFrame, floor: float, room: int) -> None:
        self.nodes, self.floor, self.room = nodes, floor, room
        self.held, self.rows, self.found = [], 0, []
        self.bytes, self.n = _bytes(nodes), max(1, nodes.count())

    def add(self, pairs: DataFrame) -> int:
        table = materialize(pairs.select("u", "v").distinct(), "pairs")
        n = table.count()
        self.held.append(table)
        self.rows += n
        if self.rows * PAIR_BYTES > self.room:
            self._compare()
        return n

    def _compare(self) -> None:
        """Both sides of the nodes are shuffled in classes, and pairs of two classes in parts, so that
        neither takes more than the room there is."""
        if self.rows:
            pairs = gathered(self.held)
            classes = max(1, -(-4 * self.bytes // self.room))
            parts = max(1, -(-2 * self.rows * self.bytes // self.n // classes**2 // self.room))
            of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
            for a in range(classes):
                for b in range(classes):
                    x, y = (self.nodes if classes == 1 else self.nodes.where(of("node", classes) == k) for k in (a, b))
                    both = pairs if classes == 1 else pairs.where((of("u", classes) == a) & (of("v", classes) == b))
                    for k in range(parts):
                        part = both if parts == 1 else both.where(F.pmod(F.xxhash64("u", "v"), F.lit(parts)) == k)
                        self.found.append(materialize(_compared(part.distinct(), x, y).where(F.col("sim") >= self.floor), "found"))
        release(*self.held)
        self.held, self.rows = [], 0

    def links(self) -> DataFrame:
        """(u, v, sim) of all pairs added that reach the floor, each once."""
        self._compare()
        if not self.found:
            return self.nodes.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("sim")).limit(0)
        links = materialize(gathered(self.found).groupBy("u", "v").agg(F.min("sim").alias("sim")), "links")
        release(*self.found)
        self.found = []
        return links


def _bytes(table: DataFrame) -> int:
    """Bytes of a written table."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _shared(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j share as many buckets as both need."""
    common = sum(np.bitwise_count((x[b][i] & x[b][j]).view(np.uint64)).astype(np.int32) for b in BITS)  # of signed numbers it counts the magnitude
    return common >= np.maximum(x["need"][i], x["need"][j])


def _adjacent(keys: DataFrame) -> DataFrame:
    """(u, v): nodes next to each other in the order of (pair, node) that may be similar. Range
    partitioning on both columns cuts a hot pair into several tasks; what is lost at a cut is left to
    the check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = {c: b.column(c).to_numpy() for c in ("pair", "node", "kind", "need", *BITS)}
            pair, node, kind = x["pair"], x["node"], x["kind"]
            at = np.flatnonzero((pair[1:] == pair[:-1]) & (node[1:] != node[:-1]) & ((kind[1:] != 2) | (kind[:-1] != 2)))
            at = at[_shared(x, at, at + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[at + 1])], ["u", "v"])

    ordered = keys.repartitionByRange("pair", "node").sortWithinPartitions("pair", "node")
    got = ordered.mapInArrow(run, "u BIGINT, v BIGINT")
    return got.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _compared(pairs: DataFrame, us: DataFrame, vs: DataFrame) -> DataFrame:
    """(u, v, sim) of the given pairs."""
    x = us.select(F.col("node").alias("u"), F.col("dims").alias("ud"), F.col("vals").alias("uv"))
    y = vs.select(F.col("node").alias("v"), F.col("dims").alias("vd"), F.col("vals").alias("vv"))

    def flat(b: pa.RecordBatch, d: str, w: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.diff(b.column(d).offsets.to_numpy())
        row = np.repeat(np.arange(len(n)), n)
        return row, b.column(d).flatten().to_numpy(), b.column(w).flatten().to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (r, d, w), (r2, d2, w2) = flat(b, "ud", "uv"), flat(b, "vd", "vv")
            _, code = np.unique(np.concatenate([d, d2]), return_inverse=True)
            width = int(code.max(initial=0)) + 1
            k, k2 = r * width + code[: len(d)], r2 * width + code[len(d) :]
            o = np.argsort(k, kind="stable")
            at = np.minimum(np.searchsorted(k[o], k2), max(len(k) - 1, 0))
            hit = k[o][at] == k2 if len(k) else np.zeros(len(k2), bool)
            sim = np.bincount(r2[hit], weights=w[o][at[hit]] * w2[hit], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(sim)], ["u", "v", "sim"])

    return pairs.join(x, "u").join(y, "v").select("u", "v", "ud", "uv", "vd", "vv").mapInArrow(run, "u BIGINT, v BIGINT, sim DOUBLE")


def _nearest(graph: DataFrame, k: int) -> DataFrame:
    """(node, nb, sim): the best ``k`` neighbours of each node, either way round."""
    both = graph.select(F.col("u").alias("node"), F.col("v").alias("nb"), "sim").unionByName(graph.select(F.col("v").alias("node"), F.col("u").alias("nb"), "sim"))
    w = Window.partitionBy("node").orderBy(F.desc("sim"), "nb")
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def neighbour_graph(keys: Keys, nodes: DataFrame, k: int, rounds: int, floor: float, room: int) -> DataFrame:
    """(u, v, sim) with u < v: the approximate graph of step 3, edges below ``floor`` left out."""
    got = Compared(nodes, floor, room)
    keys.each(keys.heads, _adjacent, got)
    graph = got.links()
    for _ in range(rounds):
        near = materialize(_nearest(graph, k).select("node", "nb"), "near")
        parts = max(1, -(-near.count() * k * PAIR_BYTES // room))
        got = Compared(nodes, floor, room)
        for i in range(parts):
            part = near.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == i)
            cand = part.join(part.select("node", F.col("nb").alias("nb2")), "node").where("nb < nb2").select(F.col("nb").alias("u"), F.col("nb2").alias("v")).distinct()
            got.add(cand.join(graph.select("u", "v"), ["u", "v"], "left_anti"))
        added = got.links()
        release(near)
        if not added.limit(1).count():
            break
        held, graph = graph, materialize(graph.unionByName(added), "graph")
        release(held, added)
    return graph


def _meeting(keys: DataFrame, own: bool) -> DataFrame:
    """(u, v) with u < v that share a key and may be similar: nodes of one component (``own``), or of two.

    Keys of a group, those of a pair or of a pair and component, meet in one task, which makes pairs
    of nodes and keeps those that share enough buckets. The nodes (of a pair: the components) of a
    group that more than ``CROWD`` have fall into blocks, and any two blocks meet as a group of their own.
    Keys of one component only are not paired otherwise, so members of a large one never meet."""
    group, item = (["pair", "comp"], "node") if own else (["pair"], "comp")
    cols = ["pair", "comp", "node", "kind", "need", *BITS]
    crowd = keys.groupBy(group).agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("n") > CROWD)
    crowd = materialize(crowd.select(*group, "n", (F.col("lo") < F.col("hi")).alias("mixed")), "crowd")
    n = crowd.count()
    if n and not own:  # blocks are of components, of which a crowd may have few
        named = keys.join(broadcast_if_small(crowd.where("mixed").select("pair"), n), "pair", "left_semi").groupBy("pair", "comp").agg(F.count("*").alias("n"))
        count = materialize(named.groupBy("pair").agg(F.count("*").alias("n")), "crowd")
        crowd = crowd.select("pair").join(count, "pair", "left").select("pair", F.coalesce("n", F.lit(0)).alias("n"))
    if n:
        size = crowd.select(*group, F.ceil(F.col("n") / CROWD).cast("int").alias("blocks"))
        k = keys.join(broadcast_if_small(size, n), group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).where("blocks > 0")
        k = k.withColumn("mine", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        k = k.select(*cols, "mine", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
    else:
        k = keys.select(*cols, F.lit(0).alias("mine"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    by = [*group, "a", "b"]
    k = k.repartition(*by).sortWithinPartitions(*by, "kind", "comp", "node")

    def paired(x: dict[str, np.ndarray], first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``first``: where a group begins."""
        n, at = len(first), np.arange(len(first))
        starts = np.flatnonzero(first)
        end = np.append(starts[1:], n)[np.cumsum(first) - 1]
        start = at + 1
        if not own:  # the next component, unless dims are single and long vectors come first
            runs = np.flatnonzero(first | (x["comp"] != np.roll(x["comp"], 1)) | (x["kind"] != np.roll(x["kind"], 1)))
            run = np.zeros(n, bool)
            run[runs] = True
            start = np.append(runs[1:], n)[np.cumsum(run) - 1]
        size = np.where(x["kind"] == 2, 0, np.maximum(end - start, 0))
        done = np.cumsum(size)
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + 2_000_000, "right")))
            c = size[low:high]
            i = np.repeat(at[low:high], c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[low:high], c)
            keep = (x["node"][i] != x["node"][j]) & ((x["mine"][i] != x["mine"][j]) | (x["a"][i] == x["b"][i]))
            if not own:
                keep &= x["comp"][i] != x["comp"][j]
            i, j = i[keep], j[keep]
            keep = _shared(x, i, j)
            u, v = x["node"][i[keep]], x["node"][j[keep]]
            if len(u):
                both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def joined(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            x = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            yield from paired(x, np.append(True, changed(x)))

        def changed(x: dict[str, np.ndarray]) -> np.ndarray:
            return np.logical_or.reduce([x[c][1:] != x[c][:-1] for c in by])

        for b in batches:
            if not b.num_rows:
                continue
            x = {c: b.column(c).to_numpy() for c in (*cols, "mine", "a", "b")}
            if held and any(held[-1][c][-1] != x[c][0] for c in by):
                yield from joined(held)
                held = []
            cuts = np.flatnonzero(changed(x))
            if len(cuts):  # all groups but the last are whole
                yield from joined([*held, {c: w[: cuts[-1] + 1] for c, w in x.items()}])
                held, x = [], {c: w[cuts[-1] + 1 :] for c, w in x.items()}
            held.append(x)
        if held:
            yield from joined(held)

    return k.mapInArrow(run, "u BIGINT, v BIGINT")


def _links(keys: Keys, nodes: DataFrame, comp: DataFrame, t: float, room: int, own: bool) -> DataFrame:
    """(u, v, sim >= t) with u < v: the exact check of step 5, of nodes in different components, or all
    links of nodes in one component (``own``)."""
    placed = keys.heads.join(comp, "node", "inner" if own else "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialize(placed, "placed")
    got = Compared(nodes, t, room)
    keys.each(placed, lambda k: _meeting(k, own), got)
    release(placed)
    return got.links()


def _louvain(u: np.ndarray, v: np.ndarray, w: np.ndarray, twice: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, community of each, numbered): one node at a time moves to the neighbouring community
    of strictly larger gain until none can, then communities become nodes, until none merge."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, top, n = code[: len(u)], code[len(u) :], np.arange(len(nodes)), len(nodes)
    while True:
        loop = np.bincount(a[a == b], w[a == b], n)
        x, y, k = np.concatenate([a[a != b], b[a != b]]), np.concatenate([b[a != b], a[a != b]]), np.tile(w[a != b], 2)
        order = np.argsort(x, kind="stable")
        y, k, at = y[order], k[order], np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))])
        deg = np.bincount(x[order], k, n) + 2 * loop
        com, tot, due, moved = np.arange(n), deg.copy(), np.ones(n, bool), True
        while moved:
            whole, moved = bool(due.all()), False
            for i in np.flatnonzero(due):
                due[i] = False
                mine = slice(at[i], at[i + 1])
                to, where = np.unique(com[y[mine]], return_inverse=True)
                if not len(to):
                    continue
                own, tot[com[i]] = com[i], tot[com[i]] - deg[i]
                gain = np.round(np.bincount(where, k[mine]) - deg[i] * tot[to] / twice, 9)
                best, held = int(gain.argmax()), np.searchsorted(to, own)
                stay = gain[held] if held < len(to) and to[held] == own else -deg[i] * tot[own] / twice
                if gain[best] > stay + 2e-9:
                    com[i], moved = to[best], True
                    due[y[mine]] = True
                tot[com[i]] += deg[i]
            if not moved and not whole:  # the queue ran dry: one look at all, as totals have changed
                due[:], moved = True, True
        names, com = np.unique(com, return_inverse=True)
        top = com[top]
        if len(names) == n:
            return nodes, top
        lo, hi = np.minimum(com[a], com[b]), np.maximum(com[a], com[b])
        n = len(names)
        pair, where = np.unique(lo * n + hi, return_inverse=True)
        a, b, w = pair // n, pair % n, np.bincount(where, w)


def _settled_apart(graph: DataFrame, twice: float) -> DataFrame:
    """(node, com) of whole components, each in one task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["u", "v"])
        nodes, com = _louvain(g["u"].to_numpy(), g["v"].to_numpy(), g["sim"].to_numpy(), twice)
        return pd.DataFrame({"node": nodes, "com": nodes[np.unique(com, return_index=True)[1]][com]})

    return graph.groupBy("comp").applyInPandas(run, "node BIGINT, com BIGINT")


def _settled_together(graph: DataFrame, twice: float, max_rounds: int) -> DataFrame:
    """(node, com) of components too large for a task: one level of local moving.

    Nodes of alternating halves move at once as long as that raises modularity; a round that does
    not is taken back. When both halves are out of such rounds, only moves are made that no other
    move of the round shares a community with: each raises modularity by its own gain, so this ends,
    and it ends where no node has a better community."""
    edge = graph.where("u <> v").select("u", "v", "sim")
    both = materialize(edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")), "both")
    ends = both.select("u", "sim").unionByName(graph.where("u = v").select("u", (2 * F.col("sim")).alias("sim")))
    state = materialize(ends.groupBy(F.col("u").alias("node")).agg(F.sum("sim").alias("deg")).withColumn("com", F.col("node")), "state")

    def modularity(state: DataFrame) -> float:
        cu, cv = state.select(F.col("node").alias("u"), F.col("com").alias("cu")), state.select(F.col("node").alias("v"), F.col("com").alias("cv"))
        inside = both.join(cu, "u").join(cv, "v").where("cu = cv").agg(F.sum("sim").alias("x")).first()["x"] or 0.0
        total = state.groupBy("com").agg(F.sum("deg").alias("tot")).agg(F.sum(F.col("tot") * F.col("tot")).alias("x")).first()["x"] or 0.0
        return inside / twice - total / twice**2

    value, refused = modularity(state), 0
    for r in range(max_rounds):
        total = state.groupBy("com").agg(F.sum("deg").alias("tot"))
        link = both.join(state.select(F.col("node").alias("v"), "com"), "v").groupBy(F.col("u").alias("node"), "com").agg(F.sum("sim").alias("k"))
        mine = state.select("node", "deg", F.col("com").alias("own"))
        scored = link.unionByName(state.select("node", "com", F.lit(0.0).alias("k"))).groupBy("node", "com").agg(F.sum("k").alias("k"))
        scored = scored.join(total, "com").join(mine, "node")
        others = F.col("tot") - F.when(F.col("com") == F.col("own"), F.col("deg")).otherwise(0.0)
        scored = scored.withColumn("g", F.round(F.col("k") - F.col("deg") * others / F.lit(twice), 9))
        best = scored.groupBy("node", "own").agg(F.max(F.struct("g", (-F.col("com")).alias("c"))).alias("b"), F.max(F.when(F.col("com") == F.col("own"), F.col("g"))).alias("stay"))
        wish = best.select("node", "own", (-F.col("b.c")).alias("to"), (F.col("b.g") - F.col("stay")).alias("more")).where("more > 2e-9")
        if refused < 2:
            wish = wish.where(F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2)
        wish = materialize(wish, "wish")
        if refused >= 2:
            first = wish.select(F.explode(F.array("own", "to")).alias("c"), "more", "node").groupBy("c").agg(F.max(F.struct("more", (-F.col("node")).alias("n"))).alias("b"))
            first = first.select((-F.col("b.n")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).where("n = 2").select("node")
            wish = wish.join(first, "node", "left_semi")
        if not wish.limit(1).count():
            if refused >= 2:
                break
            refused += 1
            continue
        new = state.join(wish.select("node", "to"), "node", "left").select("node", "deg", F.coalesce("to", "com").alias("com"))
        new = materialize(new, "state")
        if refused < 2:
            then = modularity(new)
            if then <= value + 1e-12:
                refused += 1
                continue
            value, refused = then, 0
        state = new
    else:
        raise RuntimeError(f"communities did not settle in {max_rounds} rounds")
    name = state.groupBy("com").agg(F.min("node").alias("name"))
    return state.join(name, "com").select("node", F.col("name").alias("com"))


def communities(edges: DataFrame, max_rounds: int = 1000, comp: DataFrame | None = None) -> DataFrame:
    """(node, community) by modularity: local moving until no node has a better neighbouring
    community (larger k(i, C) - k(i) tot(C) / 2m; ties stay), then the same with communities as
    nodes, until none merge.

    Communities never span components, which only share the constant 2m. So components (``comp``)
    of at most ``APART`` links are settled in one task each, larger ones together, round by round,
    until their communities have as few links. More than ``max_rounds`` rounds of a level raise."""
    twice = 2 * (edges.agg(F.sum("sim").alias("m")).first()["m"] or 0.5)
    comp = components(edges) if comp is None else comp
    graph = materialize(edges.join(comp.select(F.col("node").alias("u"), "comp"), "u").select("comp", "u", "v", "sim"), "graph")
    names = graph.select(F.explode(F.array("u", "v")).alias("doc")).distinct().withColumn("node", F.col("doc"))
    while True:
        big = materialize(graph.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > APART).select("comp"), "big")
        n = big.count()
        labels, merged = _settled_apart(graph.join(broadcast_if_small(big, n), "comp", "left_anti") if n else graph, twice), 0
        if n:
            graph = graph.join(broadcast_if_small(big, n), "comp", "left_semi")
            moved = materialize(_settled_together(graph, twice, max_rounds), "moved")
            labels, merged = labels.unionByName(moved), moved.where("node <> com").limit(1).count()
        names = materialize(names.join(labels, "node", "left").select("doc", F.coalesce("com", "node").alias("node")), "names")
        if not merged:
            break
        cu, cv = moved.select(F.col("node").alias("u"), F.col("com").alias("cu")), moved.select(F.col("node").alias("v"), F.col("com").alias("cv"))
        graph = graph.join(cu, "u").join(cv, "v").groupBy("comp", F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("sim").alias("sim"))
        graph = materialize(graph, "graph")
    name = names.groupBy("node").agg(F.min("doc").alias("community"))  # named by its smallest node
    return names.join(name, "node").select(F.col("doc").alias("node"), "community")


class Clustering:
    """Result of ``similarity_clusters``: lazy tables over written intermediate ones."""

    def __init__(self, members: DataFrame, nodes: DataFrame, comp: DataFrame, links: Callable[[], DataFrame]) -> None:
        self.members, self.nodes, self.comp, self._links = members, nodes, comp, links

    @cached_property
    def edges(self) -> DataFrame:
        """(u, v, sim) of every link, compared on first use: the groups alone do not need it."""
        return materialize(self._links(), "edges")

    def _grouped(self) -> DataFrame:
        node = self.nodes.select("key", "node", "copies").join(self.comp, "node", "left").where("comp IS NOT NULL OR copies > 1")
        return node.select("key", "node", F.coalesce("comp", "node").alias("cluster_id"))

    def assigned(self) -> DataFrame:
        """(doc_id, cluster_id) of documents in groups of two or more: cluster_id is the group's
        smallest doc_id."""
        return skew_join(self.members, self._grouped().drop("node"), "key").select("doc_id", "cluster_id")

    def groups(self) -> DataFrame:
        """(doc_id, cluster_id, n_links): ``assigned`` with the links to other distinct vectors."""
        links = self.edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        node = self._grouped().join(links, "node", "left").select("key", "cluster_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return skew_join(self.members, node, "key").select("doc_id", "cluster_id", "n_links")

    def described(self, typical: int = 5) -> DataFrame:
        """(cluster_id, community_id, n_docs, n_vectors, typical): communities with their size and
        the documents of highest internal weighted degree. Copies are counted, not spelled out."""
        com = communities(self.edges, comp=self.comp)
        inside = self.edges.join(com.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(com.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v").where("cu = cv")
        weight = inside.select(F.explode(F.array("u", "v")).alias("node"), "sim").groupBy("node").agg(F.sum("sim").alias("w"))
        node = self.nodes.select("node", "copies").join(self.comp, "node", "left").join(com, "node", "left").where("comp IS NOT NULL OR copies > 1")
        node = node.join(weight, "node", "left").select("node", "copies", F.coalesce("comp", "node").alias("cluster_id"), F.coalesce("community", "node").alias("community_id"), F.coalesce("w", F.lit(0.0)).alias("w"))
        node = materialize(node, "described")
        w = Window.partitionBy("community_id").orderBy(F.round("w", 6).desc(), "node")
        best = node.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= typical).groupBy("community_id").agg(F.sort_array(F.collect_list(F.struct("rn", "node"))).alias("t"))
        size = node.groupBy("cluster_id", "community_id").agg(F.sum("copies").alias("n_docs"), F.count("*").alias("n_vectors"))
        return size.join(best, "community_id").select("cluster_id", "community_id", "n_docs", "n_vectors", F.transform("t", lambda x: x["node"]).alias("typical"))


def similarity_clusters(
    triplets: DataFrame, similarity: float = 0.8, doc: str = "doc_id", dim: str = "dim", val: str = "val", k: int = 8, rounds: int = 2
) -> Clustering:
    """Groups of documents tied by chains of pairs with cosine at least ``similarity``."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be in (0, 1]")
    t = similarity - 1e-9
    members, nodes = nodes_of(unit_vectors(triplets, doc, dim, val))
    room = max(ROOM, 3 * _bytes(nodes) // 2)
    keys = Keys(materialize(_heads(nodes, t), "heads"), room)
    graph = neighbour_graph(keys, nodes, k, rounds, t, room)
    first = communities(graph).withColumnRenamed("community", "comp")
    first = _tied(graph, materialize(first, "communities"))
    release(graph)
    added = _links(keys, nodes, first, t, room, False)
    final = _tied(added, first) if added.limit(1).count() else first
    return Clustering(members, nodes, final, lambda: _links(keys, nodes, final, t, room, True))


def _tied(links: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, comp): ``comp`` with the parts that links tie together as one, named by its smallest node."""
    a, b = comp.select(F.col("node").alias("u"), F.col("comp").alias("cu")), comp.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    upper = links.select("u", "v").join(a, "u", "left").join(b, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v").distinct()
    upper = materialize(upper, "upper")
    top = components(upper).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    new = upper.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(comp.select("comp").distinct().withColumnRenamed("comp", "node"), "node", "left_anti")
    known = comp.unionByName(new.select("node", F.col("node").alias("comp")))
    return materialize(known.join(top, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "comp")
