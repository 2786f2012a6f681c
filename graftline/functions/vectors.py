"""Metrics: each as a Column expression over two array columns and as NumPy over rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column | str, y: Column | str) -> Column:
    """Inner product in double precision."""
    pairs = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def norm(x: Column | str) -> Column:
    return F.sqrt(dot(x, x))


def normalize(x: Column | str) -> Column:
    """Vector at length 1; a zero vector stays as it is."""
    n = norm(x)
    return F.transform(x, lambda e: F.when(n > 0, e.cast("double") / n).otherwise(e.cast("double")))


def euclidean(x: Column | str, y: Column | str) -> Column:
    squares = F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def similarity(x: Column | str, y: Column | str) -> Column:
    """Cosine; 0 if either vector is zero."""
    n = norm(x) * norm(y)
    return F.when(n > 0, dot(x, y) / n).otherwise(0.0)


def cosine(x: Column | str, y: Column | str) -> Column:
    return F.lit(1.0) - similarity(x, y)


def angular(x: Column | str, y: Column | str) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity(x, y))))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """1 - overlap of two sets; 0 for two empty sets."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, F.lit(1.0) - both / either).otherwise(0.0)


@dataclass(frozen=True)
class Metric:
    """``column(x, y)`` for expressions; ``rows(v, m)`` from one vector to the rows of a matrix."""

    name: str
    column: Callable[[Column, Column], Column]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray]
    unit: bool = False  # whether ``rows`` takes vectors of length 1


def _euclidean_rows(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.sqrt(((m - v) ** 2).sum(axis=1))


def _cosine_rows(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1.0 - (m * v).sum(axis=1)


def _angular_rows(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((m * v).sum(axis=1), -1.0, 1.0))


METRICS = {
    m.name: m
    for m in (
        Metric("euclidean", euclidean, _euclidean_rows),
        Metric("cosine", cosine, _cosine_rows, unit=True),
        Metric("angular", angular, _angular_rows, unit=True),
    )
}


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}; one of {sorted(METRICS)}")
    return METRICS[name]


def prepare(x: np.ndarray, m: Metric) -> np.ndarray:
    """Rows in double precision, at length 1 if the metric wants that; zero rows stay."""
    x = np.asarray(x, np.float64)
    if m.unit:
        n = np.sqrt((x * x).sum(axis=1))
        x = x / np.where(n > 0, n, 1.0)[:, None]
    return x
