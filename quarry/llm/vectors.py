"""Similar vectors: k nearest for every vector, and near-equal ones across splits.

Both operators share one physical design that never compares all pairs:

1. ``vector_rows`` drops unusable vectors, keeps one row per id and packs the vector into
   binary; ``distinct_vectors`` collapses exact copies before any search, so a group of
   copies that holds a third of the rows is one vector from there on.
2. ``Cells`` cuts a low-dimensional projection into half-space boxes by median splits that
   are fitted on a bounded sample; every vector is indexed in its cell.
3. Each (cell, chunk of queries) is one task: a kd-tree over the projected cell answers its
   queries, and a query is sent only to the cells its current radius reaches. Chunks follow from
   the counted queries of each cell.

Matches across splits come from a suffix array. A vector is a text whose letters are its values
on a grid; its suffixes are cut to a machine word that keeps their order, range-partitioned and
sorted, and in that order cross-split neighbours with a common prefix share a span. See
``cross_split_matches``.

Null, short, long, NaN-bearing and all-zero vectors are not part of the collection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.lineage import materialize
from quarry.plans.skew import skew_join

LEAF = 32  # points in a leaf of a radius search
BLOCK = 256  # points in a leaf of a nearest search
QUERIES = 512  # queries that are screened together
BATCH = 4096  # points that are screened by one matrix product
CHUNK = 25_000  # queries of a cell in one task
SAMPLE, SAMPLE_MAX = 8192, 65_536  # vectors the cells are fitted on: 25 MB at most at 49 dimensions
SPAN, STRIDE, GRIDS = 7, 2, 2  # letters of a prefix, suffix distance, shifted grids
NORM_BITS, NORM_UNIT = 16, 8192  # bits of a norm's logarithm in a row word, and its unit
STEP = 5.3  # grid step over the root mean square difference of a value in a pair at the limit
LEVEL, LEVEL_BITS = 1.5, 9  # ratio of norms that use one grid, bits of a level in a word
SUFFIXES = 2_000_000  # suffixes in one range of the array
HOT_SPAN = 64  # equal suffixes of one batch, and
RUN = 65_536  # cross-split pairs of one run, beyond which its rows go to the radius search


def vector_rows(df: DataFrame, dim: int, id_col: str, vec_col: str, keep: dict[str, str]) -> DataFrame:
    """(id, key, vec, *keep): one row per id, vector packed as little-endian doubles.

    ``keep`` maps output names to input columns. Rows repeated under an id count once; where
    they differ the smallest (vec, kept columns) stays, so the result is defined. Null ids
    are dropped. ``key`` is a 128-bit hash of the packed vector: equal vectors, equal key.
    """
    v = F.col(vec_col)
    good = df.where(
        F.col(id_col).isNotNull()
        & (F.size(v) == dim)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
        & F.exists(v, lambda x: x != 0)
    ).select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("v"), *[F.col(c).alias(n) for n, c in keep.items()])
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in good.schema.fields if f.name != "v"]
    names = [f.name for f in good.schema.fields if f.name != "v"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # no -0.0
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * (8 * dim)
            vec = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), vec], [*names, "vec"])

    packed = good.mapInArrow(pack, ", ".join([*fields, "vec BINARY"]))
    one = packed.groupBy("id").agg(F.min(F.struct("vec", *keep)).alias("s"))
    return one.select("id", F.unhex(F.md5("s.vec")).alias("key"), F.col("s.vec").alias("vec"), *[F.col(f"s.{n}").alias(n) for n in keep])


def distinct_vectors(rows: DataFrame, copies: int, extra: str = "id") -> DataFrame:
    """(key, vec, ids): each distinct vector with its ``copies`` smallest ids (and ``extra``).

    The rank limit is applied before the exchange as well, so a hot vector sends at most
    ``copies`` rows from each partition."""
    w = Window.partitionBy("key").orderBy("id")
    cols = list(dict.fromkeys(["id", extra]))
    few = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= copies)
    return few.groupBy("key").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list(F.struct(*cols))).alias("ids"))


def unpack(column: pd.Series | list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, dim)


def chi2_quantile(p: float, m: int) -> float:
    """x with P[chi-square of m degrees <= x] = p, for even m, by bisection on the closed form."""
    if m % 2:
        raise ValueError("the number of projections must be even")
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Cells:
    """Half-space boxes of a projected space, by median splits fitted on a bounded sample.

    ``basis`` is dim x m. The tree is complete with 2**depth cells; ``dims`` and ``vals``
    hold the splits in heap order. Cells cover the whole space, so every row has one.
    """

    def __init__(self, basis: np.ndarray, sample: np.ndarray, depth: int) -> None:
        self.basis, self.depth = basis, depth
        m, inner = basis.shape[1], 2**depth - 1
        self.dims, self.vals = np.zeros(inner, int), np.zeros(inner)
        low, high = np.full((2 * inner + 1, m), -np.inf), np.full((2 * inner + 1, m), np.inf)
        parts = {0: sample @ basis}
        for i in range(inner):
            p = parts.pop(i)
            if len(p):
                d = int(np.argmax(p.max(0) - p.min(0)))
                v = float(np.median(p[:, d]))
            else:
                d, v = 0, 0.0
            self.dims[i], self.vals[i] = d, v
            left = p[:, d] < v
            parts[2 * i + 1], parts[2 * i + 2] = p[left], p[~left]
            for c in (2 * i + 1, 2 * i + 2):
                low[c], high[c] = low[i], high[i]
            high[2 * i + 1, d] = v
            low[2 * i + 2, d] = v
        self.low, self.high = low[inner:], high[inner:]

    def of(self, projected: np.ndarray) -> np.ndarray:
        at = np.zeros(len(projected), int)
        for _ in range(self.depth):
            at = 2 * at + 1 + (projected[np.arange(len(projected)), self.dims[at]] >= self.vals[at])
        return at - (2**self.depth - 1)

    def bounds(self, projected: np.ndarray) -> np.ndarray:
        """Squared distance from each point to each cell: a lower bound for all in it."""
        out = np.zeros((len(projected), len(self.low)))
        for d in np.unique(self.dims):
            x = projected[:, d, None]
            gap = np.maximum(np.maximum(self.low[None, :, d] - x, x - self.high[None, :, d]), 0)
            out += gap * gap
        return out

    def reached(self, projected: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells) with a bound of at most ``reach``, from blocks of bounded size."""
        rows = max(1, (1 << 21) // len(self.low))
        got = [np.nonzero(self.bounds(projected[a : a + rows]) <= reach[a : a + rows, None] * (1 + 1e-9)) for a in range(0, len(projected), rows)]
        if not got:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate([r + a * rows for a, (r, _) in enumerate(got)]), np.concatenate([c for _, c in got])


def cell_depth(n: int, per_cell: int) -> int:
    """Splits so that a cell has about ``per_cell`` vectors; 4 cells at least, and no more than a
    sample of ``SAMPLE_MAX`` can place with 4 vectors in each."""
    deep = math.ceil(math.log2(n / per_cell)) if n > per_cell else 0
    return min(max(2, deep), int(math.log2(SAMPLE_MAX // 4)))


class Tree:
    """kd-tree over projected points: leaves of at most ``leaf`` points with tight boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        parts = [np.arange(len(points))]
        while parts and max(map(len, parts)) > leaf:
            nxt = []
            for p in parts:
                if len(p) <= leaf:
                    nxt.append(p)
                    continue
                x = points[p]
                d = int(np.argmax(x.max(0) - x.min(0)))
                half = len(p) // 2
                order = np.argpartition(x[:, d], half)
                nxt += [p[order[:half]], p[order[half:]]]
            parts = nxt
        self.parts = [np.sort(p) for p in parts]
        self.low = np.array([points[p].min(0) for p in parts])
        self.high = np.array([points[p].max(0) for p in parts])
        self.leaf = np.full((len(parts), leaf), -1)
        for i, p in enumerate(self.parts):
            self.leaf[i, : len(p)] = p

    def bounds(self, q: np.ndarray) -> np.ndarray:
        total = np.zeros((len(q), len(self.low)))
        for d in range(q.shape[1]):
            x = q[:, d, None]
            gap = np.maximum(np.maximum(self.low[None, :, d] - x, x - self.high[None, :, d]), 0)
            total += gap * gap
        return total


def search(tree: Tree, x: np.ndarray, q: np.ndarray, pq: np.ndarray, k: int, worst: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Per query the k nearest points of the cell: positions (-1: none) and squared distances.

    Queries near each other in the projection form a block; leaves come in the order of their
    projected distance r to the block, a few at first and then more at once. A query is done with
    a leaf, and with all at least as far, as soon as r**2 exceeds ``factor`` times its k-th squared
    distance, ``factor`` being the chi-square quantile: a true neighbour is then still unseen with
    at most the tail probability. ``worst`` bounds that distance from the start.

    Points are screened by a matrix product in single precision, with the largest error it can have
    as slack, and what passes is measured by its differences in double precision."""
    n, dim = len(q), x.shape[1]
    pos, dist = np.full((n, k), -1), np.full((n, k), np.inf)
    centre = x.mean(0)
    scale = 1 / max(np.abs(x - centre).max(initial=0), np.abs(q - centre).max(initial=0), 1e-300)
    xs, qs = (x - centre) * scale, (q - centre) * scale
    xn, qn = (xs * xs).sum(1), (qs * qs).sum(1)
    left = np.concatenate([-xs, xn[:, None] / 2], 1).astype(np.float32)  # product: |x|^2 / 2 - q x
    right = np.concatenate([qs, np.ones((n, 1))], 1).astype(np.float32)
    slack = (dim + 4) * 1.2e-7 * (np.sqrt(qn) * math.sqrt(xn.max(initial=0)) + xn.max(initial=0)) + 1e-9
    near = np.concatenate([tree.bounds(pq[a : a + 4096]).argmin(1) for a in range(0, n, 4096)])
    by_place = np.argsort(near, kind="stable")
    for a in range(0, n, QUERIES):
        block = by_place[a : a + QUERIES]
        b, limit = tree.bounds(pq[block]), worst[block]
        cp, cd = np.full((len(block), k), -1), np.full((len(block), k), np.inf)
        order, at, take = np.argsort(b.min(0), kind="stable"), 0, 2
        while at < len(order):
            kth = np.minimum(cd[:, -1], limit)
            some = order[at : at + take]
            at, take = at + take, min(2 * take, max(1, BATCH // BLOCK))
            some = some[~(b[:, some] > factor * kth[:, None]).all(0)]
            if not len(some):
                continue
            mine = np.concatenate([tree.parts[i] for i in some.tolist()])
            v = right[block] @ left[mine].T
            top = ((kth * (1 + 1e-9) * scale * scale - qn[block]) / 2 + slack[block]).astype(np.float32)
            hit = np.flatnonzero(v <= top[:, None])
            if len(hit) > 4 * k * len(block) and len(mine) > k:
                # no bound yet: the k best of the batch by screening bound the others
                part = np.partition(v, k - 1, axis=1)[:, k - 1] + 2 * slack[block].astype(np.float32)
                hit = np.flatnonzero(v <= np.minimum(top, part)[:, None])
            if not len(hit):
                continue
            r, c = np.divmod(hit, len(mine))
            diff = x[mine[c]] - q[block[r]]
            d = np.einsum("ij,ij->i", diff, diff)
            rows, inv = np.unique(r, return_inverse=True)
            fr = np.concatenate([np.repeat(np.arange(len(rows)), k), inv])
            fd = np.concatenate([cd[rows].ravel(), d])
            fp = np.concatenate([cp[rows].ravel(), mine[c]])
            o = np.lexsort((fp, fd, fr))
            first = np.searchsorted(fr[o], np.arange(len(rows)))
            keep = o[np.arange(len(o)) - first[fr[o]] < k]
            cp[rows], cd[rows] = fp[keep].reshape(-1, k), fd[keep].reshape(-1, k)
        pos[block], dist[block] = cp, cd
    pos[np.isinf(dist)] = -1
    return pos, dist


def within(tree: Tree, x: np.ndarray, q: np.ndarray, pq: np.ndarray, radius2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, positions, squared distances) of all points within each query's radius.
    The basis must be orthonormal: projected distances are then exact lower bounds."""
    for a in range(0, len(q), 1024):
        b = tree.bounds(pq[a : a + 1024])
        qi, li = np.nonzero(b <= radius2[a : a + 1024, None] * (1 + 1e-9))
        for c in range(0, len(qi), 8192):
            qs, cand = qi[c : c + 8192] + a, tree.leaf[li[c : c + 8192]]
            diff = x[cand] - q[qs][:, None, :]
            d2 = np.einsum("ijk,ijk->ij", diff, diff)
            hit = (cand >= 0) & (d2 <= radius2[qs][:, None] * (1 + 1e-9))
            r, col = np.nonzero(hit)
            yield qs[r], cand[r, col], d2[r, col]


def _fit(reps: DataFrame, n: int, dim: int, m: int, per_cell: int, orthonormal: bool, seed: int) -> Cells:
    """Cells fitted on the ``SAMPLE`` to ``SAMPLE_MAX`` vectors of smallest key: keys are hashes, so
    this is a uniform sample of bounded size. Every vector is indexed, whatever the sample."""
    depth = cell_depth(n, per_cell)
    got = reps.orderBy("key").limit(min(max(SAMPLE, 8 * 2**depth), SAMPLE_MAX)).select("vec").toPandas()["vec"]
    sample = unpack(got, dim) if len(got) else np.zeros((1, dim))
    if orthonormal:
        _, vectors = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(dim))
        basis = np.ascontiguousarray(vectors[:, ::-1][:, : min(m, dim)])
    else:
        basis = np.random.default_rng(seed).standard_normal((dim, m))
    return Cells(basis, sample, depth)


def _places(b: pa.RecordBatch, cells: Cells, dim: int, own: bool | None, radius: str | None, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) to search: each row's own cell, or all others (``own`` False) within reach of
    ``factor * radius`` squared; ``own`` None means every cell within reach."""
    p = unpack(b.column("vec").to_pylist(), dim) @ cells.basis
    at = cells.of(p)
    if own is True:
        return np.arange(len(p)), at
    row, cell = cells.reached(p, b.column(radius).to_numpy(zero_copy_only=False) * factor)
    if own is False:
        other = cell != at[row]
        row, cell = row[other], cell[other]
    return row, cell


def _spread(queries: DataFrame, cells: Cells, dim: int, own: bool | None, radius: str | None = None, factor: float = 1.0) -> DataFrame:
    """One row per query and cell to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, cell = _places(b, cells, dim, own, radius, factor)
                for a in range(0, len(row), 20_000):  # batches of bounded size, however far a query reaches
                    t = b.take(pa.array(row[a : a + 20_000]))
                    yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell[a : a + 20_000].astype(np.int32))], [*t.schema.names, "cell"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInArrow(run, f"{fields}, cell INT")


def _chunks(queries: DataFrame, cells: Cells, dim: int, own: bool | None, radius: str | None = None, factor: float = 1.0) -> DataFrame:
    """(cell, n_chunks) of the cells with queries, from the counted queries of each; one row a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(cells.low), np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(_places(b, cells, dim, own, radius, factor)[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["cell", "n"])

    got = queries.mapInArrow(run, "cell INT, n BIGINT").groupBy("cell").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("n_chunks"))
    return materialize(got, "chunks")


def _paired(index: DataFrame, queries: DataFrame, chunks: DataFrame):
    """Cogroups of a cell's vectors and one chunk of its queries: the vectors once for each chunk."""
    few = F.broadcast(chunks)  # a row a cell, ``SAMPLE_MAX`` / 4 at most
    left = index.join(few, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).drop("n_chunks")
    right = queries.join(few, "cell").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("n_chunks")).cast("int")).drop("n_chunks")
    return left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk"))


def _knn_pass(index: DataFrame, queries: DataFrame, chunks: DataFrame, cells: Cells, dim: int, k: int, factor: float) -> DataFrame:
    """(qkey, id, label, d2): for each query and cell searched its k best ids there."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["qkey", "id", "label", "d2"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in cols})
        left = left.iloc[np.argsort([i[0]["id"] for i in left["ids"]], kind="stable")]  # positions then order as smallest ids
        x, q = unpack(left["vec"], dim), unpack(right["vec"], dim)
        tree = Tree(x @ cells.basis, BLOCK)
        pos, dist = search(tree, x, q, q @ cells.basis, k, right["worst"].to_numpy(float), factor)
        size = np.array([len(i) for i in left["ids"]])
        ids = np.array([e["id"] for i in left["ids"] for e in i], np.int64)
        labels = pd.array([e["label"] for i in left["ids"] for e in i], "Int64")
        row, col = np.nonzero(pos >= 0)
        hit, d = pos[row, col], dist[row, col]
        n = size[hit]
        flat = np.repeat(np.cumsum(size)[hit] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, d = np.repeat(row, n), np.repeat(d, n)
        o = np.lexsort((ids[flat], d, row))
        row, d, flat = row[o], d[o], flat[o]
        keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] < k
        row, d, flat = row[keep], d[keep], flat[keep]
        return pd.DataFrame({"qkey": right["key"].to_numpy()[row], "id": ids[flat], "label": labels[flat], "d2": d})

    return _paired(index, queries, chunks).applyInPandas(run, "qkey BINARY, id BIGINT, label INT, d2 DOUBLE")


def _best(found: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy("d2", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_vectors(
    df: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    dim: int = 49,
    id_col: str = "id",
    vec_col: str = "features",
    label_col: str = "label",
    projections: int = 8,
    confidence: float = 0.99,
    per_cell: int = 25_000,
    seed: int = 7,
) -> DataFrame:
    """(query_id, id, label, d2, rank): the k most similar other rows of each query row.

    ``queries`` is a table with a column ``query_id``; None takes every row. Similarity is the
    sum of squared differences, ties go to the smaller id; a stopped search misses a given
    true neighbour with probability at most 1 - ``confidence`` (measured recall: README).
    Ids that name no usable vector have no rows; with fewer than k other rows all come out.
    The k-th distance found in a query's own cell bounds the cells of the second pass.
    """
    rows = materialize(vector_rows(df, dim, id_col, vec_col, {"label": label_col}), "rows")
    reps = materialize(distinct_vectors(rows, k + 1, "label"), "reps")
    n = reps.count()
    if queries is None:
        asked, targets = rows.select("key", F.col("id").alias("query_id")), reps
    else:
        wanted = queries.select(F.col("query_id").cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
        asked = materialize(rows.join(wanted, "id").select("key", F.col("id").alias("query_id")), "asked")
        targets = materialize(reps.join(asked.select("key").distinct(), "key", "left_semi"), "targets")
    cells = _fit(reps, n, dim, projections, per_cell, False, seed)
    factor = chi2_quantile(confidence, projections)
    index = materialize(_spread(reps, cells, dim, True), "index")
    far = F.lit(float("inf"))
    mine = targets.select("key", "vec", far.alias("worst"))
    first = _knn_pass(index, _spread(mine, cells, dim, True), _chunks(mine, cells, dim, True), cells, dim, k + 1, factor)
    first = materialize(first, "first")
    # a query whose cell has fewer than k + 1 ids has no bound yet and goes everywhere
    bound = first.groupBy(F.col("qkey").alias("key")).agg(F.when(F.count("*") > k, F.max("d2")).otherwise(far).alias("worst"))
    rest = materialize(targets.select("key", "vec").join(bound, "key", "left").withColumn("worst", F.coalesce("worst", far)), "rest")
    reach = ("worst", factor)
    second = _knn_pass(index, _spread(rest, cells, dim, False, *reach), _chunks(rest, cells, dim, False, *reach), cells, dim, k + 1, factor)
    near = _best(first.unionByName(second), "qkey", k + 1).select("qkey", "id", "label", "d2")
    mine = skew_join(asked, near.withColumnRenamed("qkey", "key"), "key").where("id <> query_id").select("query_id", "id", "label", "d2")
    return _best(mine, "query_id", k)


def _layout(dim: int, ratio: float) -> tuple[float, int, int, int, np.ndarray, int]:
    """(step over norm, offset of letters, bits of a letter, letters in a word, starts, bits of a
    start) of the suffixes of ``dim`` values."""
    unit = STEP / (math.sqrt(ratio) - 1) / math.sqrt(dim)
    most = math.ceil(1.2 * LEVEL / unit) + 2  # no value is larger than its norm
    bits = (2 * most + 1).bit_length()
    starts = np.arange(0, dim - SPAN + 1, STRIDE)
    place_bits = len(starts).bit_length()
    span = min(SPAN, (64 - LEVEL_BITS - (GRIDS - 1).bit_length() - place_bits) // bits)
    return unit, most, bits, span, starts, place_bits


def _suffix_keys(x: np.ndarray, level: np.ndarray, ratio: float) -> np.ndarray:
    """(rows, suffixes) words that sort as the suffixes do, cut to ``SPAN`` letters or as many as fit.

    A word holds level and grid, the place where the suffix starts (equal spans count at equal places
    only) and the letters, most significant first. A letter is a value over the level's step, rounded
    down on a grid that is shifted by a part of the step from one grid to the next. Levels count
    modulo ``2 ** LEVEL_BITS``: norms that far apart may meet as candidates, not as matches."""
    unit, most, bits, span, starts, place_bits = _layout(x.shape[1], ratio)
    step = unit * LEVEL ** level.astype(float)
    out = np.empty((len(x), GRIDS * len(starts)), np.uint64)
    for g in range(GRIDS):
        letters = (np.floor(x / step[:, None] + g / GRIDS).astype(np.int64) + most).astype(np.uint64)
        head = (level % 2**LEVEL_BITS).astype(np.uint64) * np.uint64(GRIDS) + np.uint64(g)
        word = (head[:, None] << np.uint64(place_bits)) | np.arange(len(starts), dtype=np.uint64)[None, :]
        for j in range(span):
            word = (word << np.uint64(bits)) | letters[:, starts + j]
        out[:, g * len(starts) : (g + 1) * len(starts)] = word
    return out


def _leveled(x: np.ndarray, near: float, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, level) of the norms; with ``both`` a row near the end of a level, where a match may lie
    beyond it, has a row for either."""
    norm = np.sqrt((x * x).sum(1))
    level = lambda n: np.floor(np.log(np.maximum(n, 1e-300)) / math.log(LEVEL)).astype(np.int64)
    if not both:
        return np.arange(len(x)), level(norm)
    low, high = level(norm * (1 - near) * (1 - 1e-9)), level(norm / (1 - near) * (1 + 1e-9))
    again = np.flatnonzero(low != high)
    return np.concatenate([np.arange(len(x)), again]), np.concatenate([low, high[again]])


def _shared_spans(vecs: DataFrame, n: int, dim: int, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, dense): ``pairs`` (t, h, places) of a train and a held-out vector that are neighbours in
    the suffix array with a common prefix, and at how many places (their coverage); ``dense`` (k) the vectors in
    spans too common for their pairs to be written.

    A span that comes more than ``HOT_SPAN`` times in one batch is not sent: its rows are dense, and a
    mark makes all others with that span dense as well, so neither a task nor its result grows with
    the number of rows that share a span."""
    near = 1 / math.sqrt(ratio)
    _, _, bits, span, starts, place_bits = _layout(dim, ratio)
    n_places = len(starts)
    ranges = max(16, math.ceil(n * GRIDS * n_places / SUFFIXES))
    got = vecs.orderBy("key").limit(4096).select("vec").toPandas()["vec"]  # keys are hashes: a uniform sample
    x = unpack(got, dim) if len(got) else np.ones((1, dim))
    sample = np.sort(_suffix_keys(x, _leveled(x, near, False)[1], ratio).ravel())
    cuts = np.unique(sample[np.linspace(0, len(sample) - 1, ranges + 1).astype(int)[1:-1]])
    mark = np.uint64(2**64 - 1)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, k = unpack(b.column("vec").to_pylist(), dim), b.column("k").to_numpy().view(np.uint64)
            words, rows = [], []
            for side in (0, 1):
                mine = np.flatnonzero(b.column("held" if side else "train").to_numpy(zero_copy_only=False))
                row, level = _leveled(x[mine], near, bool(side))
                w = _suffix_keys(x[mine][row], level, ratio)
                words.append(w.ravel())
                rows.append(np.repeat(k[mine][row] | np.uint64(side), w.shape[1]))
            word, row = np.concatenate(words), np.concatenate(rows)
            o = np.argsort(word, kind="stable")
            word, row = word[o], row[o]
            u, at, size = np.unique(word, return_index=True, return_counts=True)
            hot = size > HOT_SPAN
            if hot.any():
                out = np.repeat(hot, size)
                flagged = np.unique(row[out] & ~np.uint64(1))
                part = (flagged >> np.uint64(1)) % np.uint64(ranges)
                for i in np.unique(part).tolist():  # negative parts: rows, not suffixes
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - i], pa.int32()), pa.array([flagged[part == i].tobytes()])], ["part", "blob"])
                word, row = np.concatenate([word[~out], u[hot]]), np.concatenate([row[~out], np.full(hot.sum(), mark)])
                o = np.argsort(word, kind="stable")
                word, row = word[o], row[o]
            ends = np.searchsorted(word, cuts, "right")
            starts, ends = np.append(0, ends), np.append(ends, len(word))
            parts = [i for i in range(len(starts)) if ends[i] > starts[i]]
            blobs = [word[starts[i] : ends[i]].tobytes() + row[starts[i] : ends[i]].tobytes() for i in parts]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def runs(t: pa.Table) -> pa.Table:
        """One range of the suffix array: sorted, cut into runs of equal prefixes, paired."""
        blobs = [np.frombuffer(x, np.uint64) for x in t.column("blob").to_pylist()]
        names = ["t", "h", "seen"]
        if t.column("part")[0].as_py() < 0:
            k = np.unique(np.concatenate(blobs)).view(np.int64)
            return pa.table([pa.array(k), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64())], names)
        word, row = (np.concatenate([np.split(b, 2)[i] for b in blobs]) for i in (0, 1))
        o = np.lexsort((row & np.uint64(1), word))
        word, row = word[o], row[o]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(word)))
        held = np.add.reduceat((row & np.uint64(1)).astype(np.int64), first)
        marked = np.logical_or.reduceat(row == mark, first)
        # the side bit sorts a run: train suffixes first, then held-out ones
        crowded = marked | ((size - held) * held > RUN)
        dense = row[np.repeat(crowded, size)]
        dense = np.unique(dense[dense != mark] & ~np.uint64(1))
        ok = np.flatnonzero(~crowded & (held > 0) & (held < size))
        lt, lh, at = (size - held)[ok], held[ok], first[ok]
        each = lt * lh
        run = np.repeat(np.arange(len(ok)), each)
        i = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        a, b = row[at[run] + i // lh[run]], row[at[run] + lt[run] + i % lh[run]] & ~np.uint64(1)
        place = (word[at[run]] >> np.uint64(bits * span)) & np.uint64((1 << place_bits) - 1)
        seen = np.uint64(1) << (place * np.uint64(64) // np.uint64(max(n_places, 64)))  # more than 64 places share bits
        # norms of a match differ by little; their logarithms count modulo 2 ** NORM_BITS
        apart = ((a.astype(np.int64) >> 1) - (b.astype(np.int64) >> 1)) & (2**NORM_BITS - 1)
        alike = np.minimum(apart, 2**NORM_BITS - apart) <= -math.log(1 - near) * NORM_UNIT + 2
        a, b, seen = a[alike], b[alike], seen[alike]
        # a pair's places of this range as one row
        o = np.lexsort((b, a))
        a, b, seen = a[o], b[o], seen[o]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, int)
        seen = np.bitwise_or.reduceat(seen, new) if len(new) else seen
        none = pa.nulls(len(dense), pa.int64())
        cols = [np.concatenate([a[new], dense]).view(np.int64), pa.concat_arrays([pa.array(b[new].view(np.int64)), none]), pa.concat_arrays([pa.array(seen.view(np.int64)), none])]
        return pa.table([pa.array(cols[0]), cols[1], cols[2]], names)

    blobs = vecs.select("key", "k", "vec", "train", "held").mapInArrow(suffixes, "part INT, blob BINARY")
    found = materialize(blobs.groupBy("part").applyInArrow(runs, "t BIGINT, h BIGINT, seen BIGINT"), "runs")
    pairs = found.where("h IS NOT NULL").groupBy("t", "h").agg(F.bit_count(F.bit_or("seen")).alias("places"))
    return pairs, found.where("h IS NULL").select(F.col("t").alias("k")).distinct()


def _verified(pairs: DataFrame, vecs: DataFrame, dim: int, ratio: float) -> DataFrame:
    """(qkey, nkey, d2) of the pairs within the limit, by their differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, q = unpack(b.column("tv").to_pylist(), dim), unpack(b.column("hv").to_pylist(), dim)
            diff = x - q
            d2 = np.einsum("ij,ij->i", diff, diff)
            ok = np.flatnonzero(ratio * d2 <= np.maximum((x * x).sum(1), (q * q).sum(1)))
            yield pa.RecordBatch.from_arrays([b.column("qkey").take(pa.array(ok)), b.column("nkey").take(pa.array(ok)), pa.array(d2[ok])], ["qkey", "nkey", "d2"])

    t = vecs.where("train").select(F.col("k").alias("t"), F.col("key").alias("nkey"), F.col("vec").alias("tv"))
    h = vecs.where("held").select(F.col("k").alias("h"), F.col("key").alias("qkey"), F.col("vec").alias("hv"))
    both = pairs.select("t", "h").join(t, "t").join(h, "h").select("qkey", "nkey", "tv", "hv")
    return both.mapInArrow(run, "qkey BINARY, nkey BINARY, d2 DOUBLE")


def _radius_pairs(vecs: DataFrame, dim: int, ratio: float, projections: int, per_cell: int) -> DataFrame:
    """(qkey, nkey, d2): all cross-split pairs within the limit, by radius. The basis is orthonormal, so
    projected distances never exceed true ones, and a match of a lies within
    ``|a| / (sqrt(ratio) - 1)`` of it."""
    index, asked = vecs.where("train").select("key", "vec"), vecs.where("held").select("key", "vec")
    cells = _fit(index, index.count(), dim, projections, per_cell, True, 0)
    reach = 1 / (math.sqrt(ratio) - 1) ** 2

    def normed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack(b.column("vec").to_pylist(), dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x * x).sum(1) * reach)], [*b.schema.names, "r2"])

    asked = materialize(asked.mapInArrow(normed, "key BINARY, vec BINARY, r2 DOUBLE"), "asked")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["qkey", "nkey", "d2"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in cols})
        x, q = unpack(left["vec"], dim), unpack(right["vec"], dim)
        nx, nq, parts = (x * x).sum(1), (q * q).sum(1), []
        lk, rk = left["key"].to_numpy(), right["key"].to_numpy()
        for qs, ps, d2 in within(Tree(x @ cells.basis), x, q, q @ cells.basis, right["r2"].to_numpy(float)):
            ok = ratio * d2 <= np.maximum(nq[qs], nx[ps])
            parts.append(pd.DataFrame({"qkey": rk[qs[ok]], "nkey": lk[ps[ok]], "d2": d2[ok]}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in cols})

    placed = _spread(index, cells, dim, True)
    return _paired(placed, _spread(asked, cells, dim, None, "r2"), _chunks(asked, cells, dim, None, "r2")).applyInPandas(run, "qkey BINARY, nkey BINARY, d2 DOUBLE")


def cross_split_matches(
    df: DataFrame,
    ratio: float = 400.0,
    dim: int = 49,
    id_col: str = "id",
    vec_col: str = "features",
    split_col: str = "split",
    source_col: str = "source",
    train: str = "train",
    held_out: tuple[str, ...] = ("valid", "test"),
    projections: int = 8,
    per_cell: int = 20_000,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, train rows, held-out rows): the pairs of a distinct train and a distinct held-out
    vector with ``ratio * d2 <= max(|a|^2, |b|^2)``, and the rows (id, key, split, source).

    ``pairs`` has (qkey, nkey, d2), q held out. Candidates come from the suffix array of the vectors'
    texts: pairs of like norms that share a span of ``SPAN`` letters, on either of the shifted
    grids; each is then checked exactly (measured recall: README). Rows in spans that very
    many rows share, and vectors of fewer than ``4 * SPAN`` values, which have too few places, are
    searched by radius instead, which is complete. Rows of other or null splits take no part.
    """
    rows = materialize(vector_rows(df, dim, id_col, vec_col, {"split": split_col, "source": source_col}), "rows")
    t, h = rows.where(F.col("split") == train), rows.where(F.col("split").isin(*held_out))
    used = rows.where((F.col("split") == train) | F.col("split").isin(*held_out))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``k``: 47 bits of the key, the norm's logarithm, and a bit for the side. Two vectors of one
        ``k`` are compared both, as every candidate is compared in full."""
        for b in batches:
            if b.num_rows:
                x = unpack(b.column("vec").to_pylist(), dim)
                norm = np.floor(np.log(np.sqrt((x * x).sum(1))) * NORM_UNIT).astype(np.int64) & (2**NORM_BITS - 1)
                key = np.frombuffer(b"".join(v[:8] for v in b.column("key").to_pylist()), "<u8")
                k = (key << np.uint64(NORM_BITS + 1)) | (norm.astype(np.uint64) << np.uint64(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k.view(np.int64))], [*b.schema.names, "k"])

    vecs = used.groupBy("key").agg(F.first("vec").alias("vec"), F.max(F.col("split") == train).alias("train"), F.max(F.col("split").isin(*held_out)).alias("held"))
    vecs = materialize(vecs.mapInArrow(named, "key BINARY, vec BINARY, train BOOLEAN, held BOOLEAN, k BIGINT"), "vecs")
    if dim < 4 * SPAN:
        pairs = _radius_pairs(vecs, dim, ratio, projections, per_cell)
    else:
        found, dense = _shared_spans(vecs, vecs.count(), dim, ratio)
        pairs, dense = _verified(found, vecs, dim, ratio), materialize(dense, "dense")
        if dense.limit(1).count():
            more = _radius_pairs(vecs.join(dense, "k", "left_semi"), dim, ratio, projections, per_cell)
            pairs = pairs.unionByName(more).groupBy("qkey", "nkey").agg(F.min("d2").alias("d2"))
    cols = ["id", "key", "split", "source"]
    return materialize(pairs, "pairs"), t.select(cols), h.select(cols)


def match_pairs(pairs: DataFrame, t: DataFrame, h: DataFrame) -> DataFrame:
    """(train_id, held_out_id, split, source, d2): the matches with every copy spelled out."""
    a = h.select(F.col("key").alias("qkey"), F.col("id").alias("held_out_id"), "split", "source")
    b = t.select(F.col("key").alias("nkey"), F.col("id").alias("train_id"))
    return skew_join(b, skew_join(a, pairs, "qkey"), "nkey").select("train_id", "held_out_id", "split", "source", "d2")


def match_counts(pairs: DataFrame, t: DataFrame, h: DataFrame) -> DataFrame:
    """Per split and source: held-out rows, rows with a match, pairs; copies are never expanded."""
    size = t.groupBy(F.col("key").alias("nkey")).agg(F.count("*").alias("n"))
    hits = pairs.join(size, "nkey").groupBy(F.col("qkey").alias("key")).agg(F.sum("n").alias("pairs"))
    by = h.groupBy("key", "split", "source").agg(F.count("*").alias("rows"))
    both = by.join(hits, "key", "left")
    return both.groupBy("split", "source").agg(
        F.sum("rows").alias("n_rows"),
        F.sum(F.when(F.col("pairs").isNotNull(), F.col("rows")).otherwise(0)).alias("n_overlapping"),
        F.coalesce(F.sum(F.col("rows") * F.col("pairs")), F.lit(0)).cast("bigint").alias("n_pairs"),
    )
