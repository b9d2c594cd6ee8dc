"""Shared by the operators on vectors: which vectors take part, and exact integer arithmetic on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers below this are exact in double precision.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def usable(vector: str) -> Column:
    """Whether a vector is there and every component is a finite number."""
    infinity = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinity))
    return F.coalesce(F.col(vector).isNotNull() & sound, F.lit(False))


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` in double precision; exact, because ``scale`` is a power of two."""
    return np.floor(vectors.astype(np.float64) * scale)


def exact_ints(values: np.ndarray) -> np.ndarray:
    """Whole doubles of any size as Python integers."""
    flat = np.empty(values.size, object)
    flat[:] = [int(x) for x in values.ravel()]
    return flat.reshape(values.shape)


def largest(values: np.ndarray) -> float:
    return float(np.abs(values).max(initial=0.0))
