"""Partitional clustering of sparse vectors under three criterion functions.

Points are (doc_id, dim, val); an assignment is (doc_id, cluster). A cluster is described by its
composite, the sum of its points. Move rules and objectives:

* ``sse``: squared distances to the mean, smaller is better; a singleton may not leave.
* ``i2``: sum of composite lengths, larger is better.
* ``e1``: size-weighted cosine of composites to the whole collection, smaller is better.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.lineage import broadcast_if_small, materialize, release

CRITERIA = {"sse": False, "i2": True, "e1": False}  # name -> larger is better
MAX_DENSE = 5_000_000  # numbers in the k x d matrix a broadcast may hold; beyond, composites are a table
REPLAY = 4  # rounds between two writings of the clusters
MAX_SEQUENTIAL = 500_000_000  # cells of a collection that one task may write to its disk, 12 bytes each


def criterion(name: str) -> str:
    key = name.lower()
    if key not in CRITERIA:
        raise ValueError(f"unknown criterion {name!r}")
    return key


def sq_norms(points: DataFrame) -> DataFrame:
    return points.groupBy("doc_id").agg(F.sum(F.col("val") * F.col("val")).alias("sq"))


def global_composite(points: DataFrame) -> DataFrame:
    return points.groupBy("dim").agg(F.sum("val").alias("g"))


def dot_global(points: DataFrame) -> DataFrame:
    """(doc_id, xg): products with the global composite."""
    return points.join(global_composite(points), "dim").groupBy("doc_id").agg(F.sum(F.col("val") * F.col("g")).alias("xg"))


def composites(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, dim, v): sums of the members."""
    return points.join(assigned, "doc_id").groupBy("cluster", "dim").agg(F.sum("val").alias("v"))


def sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"))


def sparse_dot(points: DataFrame, comp: DataFrame) -> DataFrame:
    """(doc_id, cluster, dot) of points and composites that share a dim: an equi-join on dim."""
    small = broadcast_if_small(comp, comp.count())
    return points.join(small, "dim").groupBy("doc_id", "cluster").agg(F.sum(F.col("val") * F.col("v")).alias("dot"))


def _cluster_facts(points: DataFrame, assigned: DataFrame, g: DataFrame | None = None) -> DataFrame:
    """(cluster, n, dd, dg): size, squared length, product with the global composite ``g``, that
    of the assigned points where none is given."""
    g = global_composite(points.join(assigned, "doc_id")) if g is None else g
    c = composites(points, assigned).join(g, "dim").groupBy("cluster").agg(F.sum(F.col("v") * F.col("v")).alias("dd"), F.sum(F.col("v") * F.col("g")).alias("dg"))
    return c.join(sizes(assigned.join(points.select("doc_id").distinct(), "doc_id", "left_semi")), "cluster")


def objective(points: DataFrame, assigned: DataFrame, by: str, partial: bool = False) -> DataFrame:
    """One row with the objective; ``partial`` sums squared errors over the points' own dims only."""
    by = criterion(by)
    f = _cluster_facts(points, assigned)
    if by == "i2":
        return f.agg(F.sum(F.sqrt("dd")).alias("objective"))
    if by == "e1":
        mine = points.join(assigned, "doc_id", "left_semi")
        g = global_composite(mine).agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("gg"))
        return f.agg(F.sum(F.col("n") * F.col("dg") / F.sqrt("dd")).alias("s")).join(F.broadcast(g)).select((F.col("s") / F.col("gg")).alias("objective"))
    if partial:
        mean = composites(points, assigned).join(sizes(assigned), "cluster").select("cluster", "dim", (F.col("v") / F.col("n")).alias("c"))
        e = points.join(assigned, "doc_id").join(mean, ["cluster", "dim"])
        return e.agg(F.sum((F.col("val") - F.col("c")) * (F.col("val") - F.col("c"))).alias("objective"))
    total = points.join(assigned, "doc_id", "left_semi").agg(F.sum(F.col("val") * F.col("val")).alias("s"))
    return f.agg(F.sum(F.col("dd") / F.col("n")).alias("c")).join(F.broadcast(total)).select((F.col("s") - F.col("c")).alias("objective"))


def _leave(by: str, n: Column, dd: Column, dg: Column, dx: Column, xx: Column, xg: Column) -> Column:
    less = F.sqrt(F.greatest(dd - 2 * dx + xx, F.lit(0.0)))
    if by == "sse":
        return F.when(n > 1, -(n / (n - 1)) * (dd / (n * n) - 2 * dx / n + xx))
    if by == "i2":
        return less - F.sqrt(dd)
    return F.when(n > 1, (n - 1) * (dg - xg) / less).otherwise(0.0) - n * dg / F.sqrt(dd)


def _join(by: str, n: Column, dd: Column, dg: Column, dx: Column, xx: Column, xg: Column) -> Column:
    more = F.sqrt(F.greatest(dd + 2 * dx + xx, F.lit(0.0)))
    if by == "sse":
        return (n / (n + 1)) * (dd / (n * n) - 2 * dx / n + xx)
    if by == "i2":
        return more - F.sqrt(dd)
    return (n + 1) * (dg + xg) / more - n * dg / F.sqrt(dd)


def best_moves(points: DataFrame, assigned: DataFrame, by: str, unassigned: bool = False) -> DataFrame:
    """(doc_id, cluster, target, delta, moved): each point's best other cluster against frozen
    composites. It moves where the criterion strictly improves; ties go to the lower cluster. With
    ``unassigned``, points without a cluster come too and only join (cluster null, moved).

    Points are partitioned by doc_id once. Products with the clusters a point shares a dim with are
    one map a point; every cluster is then scored in that row, so no point-cluster pair moves."""
    by = criterion(by)
    mine = (points if unassigned else points.join(assigned, "doc_id", "left_semi")).repartition("doc_id")
    members = points.join(assigned, "doc_id", "left_semi") if unassigned else mine
    total = global_composite(mine)
    facts = materialize(_cluster_facts(members, assigned, total), "facts")
    dots = sparse_dot(mine, materialize(composites(members, assigned), "composites"))
    dots = dots.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "dot"))).alias("dots"))
    x = mine.join(total, "dim", "left").groupBy("doc_id").agg(F.sum(F.col("val") * F.col("val")).alias("sq"), F.coalesce(F.sum(F.col("val") * F.col("g")), F.lit(0.0)).alias("xg"))
    x = x.join(assigned, "doc_id", "left" if unassigned else "inner").join(dots, "doc_id", "left")
    # one row with all clusters is broadcast: k structs
    every = facts.agg(F.collect_list(F.struct("cluster", "n", "dd", "dg")).alias("every"))
    c = F.col
    rows = x.crossJoin(F.broadcast(every))
    dot_with = lambda f: F.coalesce(F.try_element_at("dots", f["cluster"]), F.lit(0.0))
    own = F.element_at(F.filter("every", lambda f: f["cluster"] == c("cluster")), 1)
    rows = rows.withColumn("own", F.when(c("cluster").isNotNull(), own)).withColumn("odot", F.when(c("cluster").isNotNull(), F.coalesce(F.try_element_at("dots", c("cluster")), F.lit(0.0))))
    o = c("own")
    rows = rows.withColumn("leave", F.when(c("cluster").isNull(), 0.0).otherwise(_leave(by, o["n"], o["dd"], o["dg"], c("odot"), c("sq"), c("xg"))))
    sign = -1.0 if CRITERIA[by] else 1.0

    def scored(f: Column) -> Column:
        delta = F.round(c("leave") + _join(by, f["n"], f["dd"], f["dg"], dot_with(f), c("sq"), c("xg")), 9)
        return F.struct((sign * delta).alias("o"), f["cluster"].alias("target"), delta.alias("delta"))

    other = F.filter("every", lambda f: c("cluster").isNull() | (f["cluster"] != c("cluster")))
    best = rows.select("doc_id", "cluster", F.array_min(F.filter(F.transform(other, scored), lambda s: s["delta"].isNotNull())).alias("b")).where("b IS NOT NULL")
    better = c("delta") > 0 if CRITERIA[by] else c("delta") < 0
    return best.select("doc_id", "cluster", "b.target", "b.delta").withColumn("moved", better | c("cluster").isNull())


def initial_seeds(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(doc_id, cluster): ``k`` distinct points by the order of a seeded hash."""
    ids = points.select("doc_id").distinct().withColumn("h", F.md5(F.concat_ws(":", "doc_id", F.lit(seed))))
    rows = [(r["doc_id"], i) for i, r in enumerate(ids.orderBy("h", "doc_id").limit(k).collect())]
    return points.sparkSession.createDataFrame(rows, "doc_id BIGINT, cluster INT")


def packed(points: DataFrame) -> DataFrame:
    """(doc_id, dims, vals) of each point."""
    s = points.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("dim", "val"))).alias("e"))
    return s.select("doc_id", F.transform("e", lambda e: e["dim"].cast("int")).alias("dims"), F.transform("e", lambda e: e["val"]).alias("vals"))


def _score(by: str, n: np.ndarray, dd: np.ndarray, dg: np.ndarray, dots: np.ndarray, xx: np.ndarray, xg: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Change of the criterion, smaller better, for every point and cluster; own cluster 0, an
    unassigned point (-1) only joins; infinite where a move is not allowed."""
    sign = -1.0 if CRITERIA[by] else 1.0
    ok = n > 0
    with np.errstate(all="ignore"):
        root = np.sqrt(dd)
        more, less = (np.sqrt(np.maximum(dd + s * 2 * dots + xx[:, None], 0)) for s in (1, -1))
        if by == "sse":
            far = dd / (n * n) - 2 * dots / n + xx[:, None]
            join, leave = n / (n + 1) * far, np.where(n > 1, -n / (n - 1) * far, np.inf)
        elif by == "i2":
            join, leave = more - root, less - root
        else:
            was = n * dg / root
            join, leave = (n + 1) * (dg + xg[:, None]) / more - was, np.where(n > 1, (n - 1) * (dg - xg[:, None]) / less, 0) - was
    has = own >= 0
    out = sign * join
    rows = np.flatnonzero(has)
    with np.errstate(invalid="ignore"):
        out[rows] += (sign * leave[rows, own[rows]])[:, None]
    out[:, ~ok] = np.inf
    out[rows, own[rows]] = 0.0
    return np.where(np.isnan(out), np.inf, out)


def fit(points: DataFrame, k: int, by: str = "i2", seed: int = 1, max_iter: int = 30, stop: float = 0.1) -> tuple[DataFrame, float]:
    """((doc_id, cluster), objective): batch moves from ``k`` seed points until fewer than ``stop``
    of the points move or ``max_iter`` rounds are over. ``e1`` moves alternating halves of the
    points, since its composites must not all change at once.

    The k x d composites are broadcast while they are at most ``MAX_DENSE`` numbers; beyond that
    they stay a table and each round is a join (``best_moves``). A dense round is one pass that
    leaves only sums: points are read with the clusters of the last written round, and the few
    rounds since are replayed. Every ``REPLAY`` rounds the clusters are written again."""
    by = criterion(by)
    pts = materialize(packed(points), "points")
    top = pts.select(F.max(F.array_max("dims")).alias("m"), F.count("*").alias("n")).first()
    if not top["n"]:
        return points.sparkSession.createDataFrame([], "doc_id BIGINT, cluster INT"), 0.0
    d = top["m"] + 1
    k = min(k, top["n"])
    seeds = initial_seeds(points, k, seed)
    if k * d > MAX_DENSE:
        return _fit_joined(points, seeds, by, max_iter, stop, top["n"])
    state = pts.join(F.broadcast(seeds), "doc_id", "left").select("doc_id", "dims", "vals", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    state = written = materialize(state, "state")
    g = np.zeros(d)
    for r in global_composite(points).collect():
        g[r["dim"]] = r["g"]
    context = points.sparkSession.sparkContext

    def replayed(b: pa.RecordBatch, shared: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Dims and values, point of each, clusters before and after the last of the rounds."""
        size = np.diff(b.column("dims").offsets.to_numpy())
        dims, vals = b.column("dims").flatten().to_numpy(), b.column("vals").flatten().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        add = lambda w: np.bincount(row, weights=w, minlength=len(size))
        xx, xg = add(vals * vals), add(vals * g[dims])
        own = new = b.column("cluster").to_numpy()
        for one in shared:
            m, n, dd, dg, half = one.value
            own = new
            dots = np.stack([add(vals * m[j, dims]) for j in range(k)], 1)
            s = np.round(_score(by, n, dd, dg, dots, xx, xg, own), 12)
            best = s.argmin(1)
            go = (own < 0) | (s[np.arange(len(s)), best] < 0)
            if half is not None:
                go &= (own < 0) | (b.column("doc_id").to_numpy() % 2 == half)
            new = np.where(go, best, own).astype(np.int32)
        return dims, vals, row, own, new

    def sums(df: DataFrame, shared: list) -> tuple[np.ndarray, np.ndarray, float, int]:
        """Composites, sizes, squared length of all assigned points, points that moved."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count, sq, moved = np.zeros(k * d), np.zeros(k), 0.0, 0
            for b in batches:
                dims, vals, row, own, new = replayed(b, shared)
                moved += int((new != own).sum())
                at = new[row].astype(np.int64)
                inside = at >= 0
                total += np.bincount((at * d + dims)[inside], weights=vals[inside], minlength=k * d)
                count += np.bincount(new[new >= 0], minlength=k)
                sq += float((vals[inside] ** 2).sum())
            hit = np.flatnonzero(total)
            code = np.concatenate([hit, -1 - np.arange(k), [-1 - k, -2 - k]])
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.concatenate([total[hit], count, [sq, moved]]))], ["code", "v"])

        got = df.mapInArrow(run, "code BIGINT, v DOUBLE").groupBy("code").agg(F.sum("v").alias("v")).toPandas()
        code, v = got["code"].to_numpy(), got["v"].to_numpy()
        total, count = np.zeros(k * d), np.zeros(k)
        total[code[code >= 0]] = v[code >= 0]
        sizes = (code < 0) & (code > -1 - k)
        count[-1 - code[sizes]] = v[sizes]
        return total.reshape(k, d), count, float(v[code == -1 - k].sum()), int(v[code == -2 - k].sum())

    def moved_to(df: DataFrame, shared: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = replayed(b, shared)[4]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("dims"), b.column("vals"), pa.array(new)], ["doc_id", "dims", "vals", "cluster"])

        return df.mapInArrow(run, "doc_id BIGINT, dims ARRAY<INT>, vals ARRAY<DOUBLE>, cluster INT")

    m, n, sq, _ = sums(state, [])
    rounds: list = []
    for it in range(max_iter):
        rounds.append(context.broadcast((m, n, (m * m).sum(1), m @ g, it % 2 if by == "e1" and it else None)))
        m, n, sq, moved = sums(written, rounds)
        last = moved < stop * top["n"] or it + 1 == max_iter
        if last or len(rounds) == REPLAY:
            state = materialize(moved_to(written, rounds), "state")
            release(written)
            for r in rounds:
                r.destroy()
            written, rounds = state, []
        if last:
            break
    dd = (m * m).sum(1)
    live = n > 0
    value = {"sse": sq - float((dd[live] / n[live]).sum()), "i2": float(np.sqrt(dd).sum()), "e1": float((n[live] * (m @ g)[live] / np.sqrt(dd[live])).sum() / max(np.sqrt(g @ g), 1e-300))}[by]
    return written.select("doc_id", "cluster"), value


def _fit_joined(points: DataFrame, seeds: DataFrame, by: str, max_iter: int, stop: float, n: int) -> tuple[DataFrame, float]:
    """``fit`` with composites as a table: nothing of the size k x d is held in one place."""
    points = materialize(points, "points")
    ids = materialize(points.select("doc_id").distinct(), "ids")
    state = materialize(ids.join(F.broadcast(seeds), "doc_id", "left"), "state")
    for it in range(max_iter):
        move = best_moves(points, state.where("cluster IS NOT NULL"), by, unassigned=True).where("moved").select("doc_id", "target", "cluster")
        if by == "e1" and it:
            move = move.where(F.col("cluster").isNull() | (F.pmod("doc_id", F.lit(2)) == it % 2))
        last = state
        new = last.join(move.select("doc_id", "target"), "doc_id", "left").select("doc_id", F.coalesce("target", "cluster").alias("cluster"), F.col("target").isNotNull().alias("moved"))
        new = materialize(new, "state")
        state, moved = new.select("doc_id", "cluster"), new.where("moved").count()
        release(last)
        if moved < stop * n:
            break
    state = state.where("cluster IS NOT NULL")
    return state, objective(points, state, by).first()["objective"]


def fit_sequential(points: DataFrame, k: int, by: str = "e1", trials: int = 1, max_iter: int = 30, stop: float = 0.1) -> DataFrame:
    """(trial, doc_id, cluster, objective): point-by-point moves in the order of the ids, composites
    following each move, as the criterion functions are defined; trials run side by side.

    A move depends on the one before, so a trial is one task that passes over all points. It keeps them in files of its own
    machine and k x d composites in memory. Points ahead are scored together, up to the first that moves: until then nothing changes.
    A collection of more than ``MAX_SEQUENTIAL`` cells is an error, and ``fit`` is the way that scales."""
    by = criterion(by)
    pts = materialize(packed(points), "points")
    cells = pts.agg(F.coalesce(F.sum(F.size("dims")), F.lit(0)).alias("n")).first()["n"]
    if cells > MAX_SEQUENTIAL:
        raise ValueError(f"{cells} cells are more than {MAX_SEQUENTIAL}; use fit")
    rows = pts.select(F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"), "doc_id", "dims", "vals")
    rows = rows.repartitionById(trials, "trial").sortWithinPartitions("trial", "doc_id")

    def one_trial(trial: int, ids: np.ndarray, size: np.ndarray, used: np.ndarray, folder: str) -> tuple[np.ndarray, float]:
        """Clusters and objective; the files hold the cells in the order of the ids."""
        dims, vals = np.memmap(f"{folder}/dims", np.int32, "r+"), np.memmap(f"{folder}/vals", np.float64, "r")
        start = np.concatenate([[0], np.cumsum(size)])
        n_clusters, d, g = min(k, len(ids)), len(used), np.zeros(len(used))
        xx, xg = np.empty(len(ids)), np.empty(len(ids))
        spans = [(i, min(i + 20_000, len(ids))) for i in range(0, len(ids), 20_000)]
        for i, j in spans:
            at = np.searchsorted(used, dims[start[i] : start[j]]).astype(np.int32)
            dims[start[i] : start[j]] = at
            v = vals[start[i] : start[j]]
            g += np.bincount(at, weights=v, minlength=d)
            xx[i:j] = np.add.reduceat(v * v, start[i:j] - start[i])
        for i, j in spans:
            xg[i:j] = np.add.reduceat(vals[start[i] : start[j]] * g[dims[start[i] : start[j]]], start[i:j] - start[i])
        m, n, own = np.zeros((d, n_clusters)), np.zeros(n_clusters), np.full(len(ids), -1)
        for c, i in enumerate(np.random.default_rng(2 * trial + 1).choice(len(ids), n_clusters, replace=False)):
            m[dims[start[i] : start[i + 1]], c] = vals[start[i] : start[i + 1]]
            n[c], own[i] = 1, c
        dd, dg = (m * m).sum(0), g @ m
        for _ in range(max_iter):
            moved, i, ahead = 0, 0, 1
            while i < len(ids):
                j = min(i + ahead, len(ids))
                a, z = start[i], start[j]
                dots = np.add.reduceat(m[dims[a:z]] * vals[a:z, None], start[i:j] - a)
                s = np.round(_score(by, n, dd, dg, dots, xx[i:j], xg[i:j], own[i:j]), 12)
                best = s.argmin(1)
                go = np.flatnonzero((own[i:j] < 0) | (s[np.arange(j - i), best] < 0))
                if not len(go):
                    i, ahead = j, min(2 * ahead, 256)
                    continue
                f, to = i + int(go[0]), int(best[go[0]])
                ahead = max(1, (3 * ahead + 2 * int(go[0])) // 4)
                at, v = dims[start[f] : start[f + 1]], vals[start[f] : start[f + 1]]
                for c, sign in ((own[f], -1.0), (to, 1.0)):
                    if c >= 0:
                        m[at, c] += sign * v
                        n[c] += sign
                        dd[c], dg[c] = m[:, c] @ m[:, c], m[:, c] @ g
                own[f] = to
                moved += 1
                i = f + 1
            if moved < stop * len(ids):
                break
        live = n > 0
        value = {"sse": float(xx.sum() - (dd[live] / n[live]).sum()), "i2": float(np.sqrt(dd).sum()), "e1": float((n[live] * dg[live] / np.sqrt(np.maximum(dd[live], 1e-300))).sum() / np.sqrt(g @ g))}[by]
        return own, value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((int(t), b.filter(pc.equal(b.column("trial"), t))) for b in batches for t in np.unique(b.column("trial").to_numpy()))
        for trial, own in groupby(parts, lambda x: x[0]):
            with tempfile.TemporaryDirectory() as folder:
                ids, size, used = [], [], np.empty(0, np.int32)
                with open(f"{folder}/dims", "wb") as to_dims, open(f"{folder}/vals", "wb") as to_vals:
                    for _, b in own:
                        dims = b.column("dims").flatten().to_numpy()
                        dims.astype(np.int32).tofile(to_dims)
                        b.column("vals").flatten().to_numpy().tofile(to_vals)
                        ids.append(b.column("doc_id").to_numpy().copy())
                        size.append(pc.list_value_length(b.column("dims")).to_numpy().astype(np.int64))
                        used = np.union1d(used, dims)
                ids = np.concatenate(ids)
                clusters, value = one_trial(trial, ids, np.concatenate(size), used, folder)
            n = len(ids)
            cols = [np.full(n, trial, np.int32), ids, clusters.astype(np.int32), np.full(n, value)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["trial", "doc_id", "cluster", "objective"])

    return rows.mapInArrow(run, "trial INT, doc_id BIGINT, cluster INT, objective DOUBLE")


def best_trial(points: DataFrame, k: int, by: str = "i2", trials: int = 3, **kw) -> tuple[DataFrame, pd.DataFrame]:
    """The assignment of the best of several seeded fits, and (trial, objective) of all."""
    got = [fit(points, k, by, seed=2 * t + 1, **kw) for t in range(trials)]
    log = pd.DataFrame({"trial": range(trials), "objective": [v for _, v in got]})
    at = int(log["objective"].idxmax() if CRITERIA[criterion(by)] else log["objective"].idxmin())
    return got[at][0], log
