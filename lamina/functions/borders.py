"""Where an index outside an axis reads from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("zero", "value", "clamp", "periodic", "mirror", "reflect")


def border_index(i: Column, n: int, mode: str) -> Column:
    """The index that is read instead of i; null where the border's value is."""
    if mode in ("zero", "value"):
        return F.when((i >= 0) & (i < n), i)
    if mode == "clamp":
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    if mode == "periodic":
        return F.pmod(i, F.lit(n))
    if mode == "mirror":
        j = F.when(i < 0, -i - 1).otherwise(i) % (2 * n)
        return F.when(j >= n, 2 * n - 1 - j).otherwise(j)
    if mode == "reflect":
        if n == 1:
            return i * 0
        j = F.abs(i) % (2 * n - 2)
        return F.when(j >= n, 2 * n - 2 - j).otherwise(j)
    raise ValueError(f"unknown border {mode}")


def border_places(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """border_index of an array, with -1 where the border's value is."""
    if mode in ("zero", "value"):
        return np.where((i >= 0) & (i < n), i, -1)
    if mode == "clamp":
        return np.clip(i, 0, n - 1)
    if mode == "periodic":
        return i % n
    if mode == "mirror":
        j = np.where(i < 0, -i - 1, i) % (2 * n)
        return np.where(j >= n, 2 * n - 1 - j, j)
    if mode == "reflect":
        j = np.abs(i) % max(1, 2 * n - 2)
        return np.where(j >= n, 2 * n - 2 - j, j)
    raise ValueError(f"unknown border {mode}")
