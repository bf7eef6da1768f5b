"""Products, decompositions and reshapes of row matrices (id, features)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def gram(df: DataFrame, dim: int) -> DataFrame:
    """(i, j, v) of the features' Gram matrix: one dim x dim sum a partition, then one sum each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for b in batches:
            x = stacked(b.column("features"), dim)
            g += x.T @ x
        i, j = np.divmod(np.arange(dim * dim, dtype=np.int32), np.int32(dim))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(g.ravel())], ["i", "j", "v"])

    part = df.select("features").mapInArrow(run, "i INT, j INT, v DOUBLE")
    return part.groupBy("i", "j").agg(F.sum("v").alias("v"))


def label_sums(df: DataFrame) -> DataFrame:
    """(label, i, v): column sums of the rows of each label; X'y of any coding follows from it."""
    e = df.select("label", F.posexplode("features").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.sum("x").alias("v"))


def long_form(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("features").alias("dim", "val"))


def transposed(df: DataFrame) -> DataFrame:
    """(dim, id, val): the matrix by columns."""
    return long_form(df).select("dim", "id", "val")


def block_mean(df: DataFrame, height: int, width: int, block: int) -> DataFrame:
    """(id, br, bc, val): means of block x block cells of a row-major image, edges included."""
    p = F.col("dim")
    cells = long_form(df).where(p < height * width).select(
        "id", F.floor(F.floor(p / width) / block).cast("int").alias("br"), F.floor((p % width) / block).cast("int").alias("bc"), "val"
    )
    return cells.groupBy("id", "br", "bc").agg(F.avg("val").alias("val"))


def gram_matrix(df: DataFrame, dim: int) -> np.ndarray:
    """The Gram matrix on the driver: dim x dim numbers, whatever the number of rows."""
    g = np.zeros((dim, dim))
    for r in gram(df, dim).collect():
        g[r["i"], r["j"]] = r["v"]
    return g


def singular_values(df: DataFrame, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, right vectors) of the top ``k``, from the Gram matrix; columns are not centred."""
    w, v = np.linalg.eigh(gram_matrix(df, dim))
    o = np.argsort(w)[::-1][:k]
    v = v[:, o]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)  # a defined sign
    return np.sqrt(np.maximum(w[o], 0)), v


def projection(s: np.ndarray, v: np.ndarray, scaled: bool) -> np.ndarray:
    """What takes rows into the space of the right vectors ``v`` of values ``s``: to U S if ``scaled``, else to U."""
    return v if scaled else v / np.where(s > 0, s, np.inf)


def svd_project(df: DataFrame, dim: int, k: int, scaled: bool = True) -> DataFrame:
    """Rows in the space of the top ``k`` right vectors: U S if ``scaled``, else U."""
    s, v = singular_values(df, dim, k)
    m = projection(s, v, scaled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = stacked(b.column("features"), dim) @ m
            off = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.ListArray.from_arrays(off, pa.array(y.ravel()))], ["id", "label", "features"])

    return df.select("id", "label", "features").mapInArrow(run, "id BIGINT, label INT, features ARRAY<DOUBLE>")
