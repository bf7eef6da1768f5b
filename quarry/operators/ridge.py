"""One-against-rest ridge regression by cyclic coordinate descent on sufficient statistics.

One distributed pass gives the Gram matrix, the column sums of each label and the row counts;
everything after that is d x d work on the driver, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.matrix import gram_matrix, label_sums, stacked
from quarry.plans.lineage import materialize

#: fixed values: the regularisation grid of the classic experiment
LAMBDAS = (0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0)
MAX_LABELS = 10_000


@dataclass
class Stats:
    """Gram matrix, labels, X'y per label and y'y, for targets +1 / -1 or 1 / 0."""

    g: np.ndarray
    labels: list[int]
    b: np.ndarray
    yy: np.ndarray


def statistics(df: DataFrame, dim: int, nonneg: bool = False) -> Stats:
    counts = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    s = np.zeros((len(labels), dim))
    for r in label_sums(df).collect():
        s[labels.index(r["label"]), r["i"]] = r["v"]
    n = np.array([counts[x] for x in labels], float)
    b = s if nonneg else 2 * s - s.sum(0)
    return Stats(gram_matrix(df, dim), labels, b, n if nonneg else np.full(len(labels), n.sum()))


def objective(st: Stats, k: int, w: np.ndarray, lam: float) -> float:
    """||Xw - y||^2 + lam ||w||^2 without a pass over the rows."""
    return float(w @ st.g @ w - 2 * st.b[k] @ w + st.yy[k] + lam * w @ w)


def descend(st: Stats, lam: float, nonneg: bool = False, sweeps: int | None = None, tol: float = 1e-4) -> tuple[np.ndarray, list[int]]:
    """(weights by label, sweeps used): from zero, coordinates in order, no intercept, until the
    objective falls by at most ``tol`` of itself, which it must at last, as it stays above zero;
    or for exactly ``sweeps`` sweeps."""
    out, used = np.zeros_like(st.b), []
    for k in range(len(st.labels)):
        w = np.zeros(st.g.shape[0])
        last = objective(st, k, w, lam)
        for sweep in count(1):
            for i in range(len(w)):
                top = st.b[k, i] - st.g[i] @ w + st.g[i, i] * w[i]
                bottom = st.g[i, i] + lam
                w[i] = 0.0 if bottom == 0 or (nonneg and top <= 0) else top / bottom
            now = objective(st, k, w, lam)
            if sweep == sweeps or not sweeps and not last - now > tol * abs(last):
                break
            last = now
        out[k] = w
        used.append(sweep)
    return out, used


def weight_table(df: DataFrame, st: Stats, w: np.ndarray) -> DataFrame:
    """(label, dim, w)."""
    rows = [(int(lab), i, float(v)) for lab, ws in zip(st.labels, w) for i, v in enumerate(ws)]
    return df.sparkSession.createDataFrame(rows, "label INT, dim INT, w DOUBLE")


def binarized(df: DataFrame, nonneg: bool = False) -> DataFrame:
    """(id, target, y): each row against each label of the data; more than ``MAX_LABELS`` are an error."""
    labels = materialize(df.select(F.col("label").alias("target")).distinct(), "labels")
    if (n := labels.count()) > MAX_LABELS:
        raise ValueError(f"{n} labels are more than {MAX_LABELS}")
    y = F.when(F.col("label") == F.col("target"), 1).otherwise(0 if nonneg else -1)
    return df.select("id", "label").join(F.broadcast(labels)).select("id", "target", y.alias("y"))


def predict(df: DataFrame, st: Stats, w: np.ndarray) -> DataFrame:
    """(id, label, pred): the label of the largest score, the smallest label on ties."""
    labels = np.array(st.labels, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = (stacked(b.column("features"), w.shape[1]) @ w.T).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(labels[best])], ["id", "label", "pred"])

    return df.select("id", "label", "features").mapInArrow(run, "id BIGINT, label INT, pred INT")


def validate(train: DataFrame, valid: DataFrame, dim: int, nonneg: bool = False, lambdas: tuple[float, ...] = LAMBDAS, sweeps: int | None = None) -> DataFrame:
    """(lam, accuracy) for each lambda; all share one pass over the train rows and one over valid."""
    st = statistics(train, dim, nonneg)
    ws = [descend(st, lam, nonneg, sweeps)[0] for lam in lambdas]
    labels = np.array(st.labels, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, n = np.zeros(len(ws), np.int64), 0
        for b in batches:
            x, y = stacked(b.column("features"), dim), b.column("label").to_numpy()
            n += len(y)
            hit += [int((labels[(x @ w.T).argmax(1)] == y).sum()) for w in ws]
        yield pa.RecordBatch.from_arrays([pa.array(list(lambdas)), pa.array(hit), pa.array(np.full(len(ws), n))], ["lam", "hit", "n"])

    part = valid.select("label", "features").mapInArrow(run, "lam DOUBLE, hit BIGINT, n BIGINT")
    return part.groupBy("lam").agg((F.sum("hit") / F.sum("n")).alias("accuracy"))


def classify(train: DataFrame, valid: DataFrame, test: DataFrame, dim: int, nonneg: bool = False, sweeps: int | None = None) -> DataFrame:
    """Choose lambda on ``valid`` (the first best of the grid), refit on both, predict ``test``."""
    best = validate(train, valid, dim, nonneg, sweeps=sweeps).orderBy(F.desc("accuracy"), "lam").first()
    st = statistics(train.unionByName(valid), dim, nonneg)
    return predict(test, st, descend(st, best["lam"] if best else LAMBDAS[0], nonneg, sweeps)[0])
