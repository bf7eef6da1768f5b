"""Column builders over arrays of doubles. A zero vector has no similarity: null, ranked last."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def sq_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b)), F.lit(0.0))


def ext_jaccard(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(sq_norm(a) + sq_norm(b) - dot(a, b), F.lit(0.0))


def axpby(s: float, a: Column, t: float, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.lit(s) * x + F.lit(t) * y)


class Measure:
    """A proximity with its direction, as a column and as a block of products and norms."""

    def __init__(self, column: Callable[[Column, Column], Column], block: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], larger_is_nearer: bool, digits: int) -> None:
        self.column, self.block, self.larger_is_nearer, self.digits = column, block, larger_is_nearer, digits


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.full(np.broadcast(x, y).shape, np.nan), where=y != 0)


#: name or number of a measure -> how to compute it from dot products and squared norms
MEASURES: dict[str, Measure] = {
    "l2": Measure(sq_euclidean, lambda d, p, q: np.maximum(p + q - 2 * d, 0), False, 6),
    "cosine": Measure(cosine, lambda d, p, q: _ratio(d, np.sqrt(p) * np.sqrt(q)), True, 9),
    "jaccard": Measure(ext_jaccard, lambda d, p, q: _ratio(d, p + q - d), True, 9),
}
NUMBERED = {1: "l2", 2: "cosine", 3: "jaccard"}


def measure(name: str | int) -> Measure:
    """By name in any case, or by number 1, 2, 3; anything else raises."""
    key = NUMBERED.get(name, "") if isinstance(name, int) else name.lower()
    if key not in MEASURES:
        raise ValueError(f"unknown measure {name!r}")
    return MEASURES[key]
