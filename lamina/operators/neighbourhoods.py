"""Convolution and median filters, relational and dense.

The forms over pixels take images of any size, as tiles with halos. The dense forms take one image a row through numpy, without
a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..model import AXES, Shape
from .dense import dense
from .tiles import tiled

PAD = {"zero": "constant", "reflect": "reflect"}


def _halo(window: Shape) -> Shape:
    if any(n % 2 == 0 for n in window):
        raise ValueError("windows must have odd sizes")
    return tuple(n // 2 for n in window)


def _cube(kernel: np.ndarray) -> np.ndarray:
    kernel = np.asarray(kernel, float)
    return kernel.reshape((1,) * (3 - kernel.ndim) + kernel.shape)


def _weighted(padded: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sum of padded(i + d) * kernel(d), a term at a time."""
    out = np.zeros([p - k + 1 for p, k in zip(padded.shape, kernel.shape, strict=True)])
    for at in np.ndindex(kernel.shape):
        if kernel[at]:
            out += kernel[at] * padded[tuple(slice(i, i + n) for i, n in zip(at, out.shape, strict=True))]
    return out


def convolve(pixels: DataFrame, shape: Shape, kernel: np.ndarray, border: str = "zero") -> DataFrame:
    """Sum of in(i + d) * kernel(d) over an odd kernel, not flipped, for every pixel whose window holds one that is present."""
    kernel = _cube(kernel)
    taps = (kernel != 0).astype(float)
    return tiled(pixels, shape, _halo(kernel.shape), border, lambda a: _weighted(a, kernel), lambda there: _weighted(there, taps) > 0)


def convolve_separable(pixels: DataFrame, kernels: dict[str, list[float]], border: str = "zero", shape: Shape | None = None) -> DataFrame:
    """One 1-d kernel (of odd size) per axis, z, then y, then x. With a zero border each pass is a window along its lines; other
    borders need the shape, and each pass a join of what its pixels read."""
    out = pixels
    for k, axis in enumerate(AXES):
        kernel = kernels.get(axis)
        if not kernel:
            continue
        half = len(kernel) // 2
        if border != "zero":
            along = [1, 1, 1]
            along[k] = len(kernel)
            out = convolve(out, shape, np.asarray(kernel, float).reshape(along), border)
            continue
        line = W.partitionBy("image_id", *[a for a in AXES if a != axis]).orderBy(axis)
        total = F.lit(0.0)
        for at, weight in enumerate(kernel):
            step = at - half
            near = F.lead("v", step, 0.0).over(line) if step >= 0 else F.lag("v", -step, 0.0).over(line)
            total = total + near * F.lit(float(weight))
        out = out.withColumn("v", total)
    return out


def median_filter(pixels: DataFrame, shape: Shape, window: Shape, border: str = "reflect") -> DataFrame:
    """The exact median of each odd window."""
    view = np.lib.stride_tricks.sliding_window_view
    return tiled(pixels, shape, _halo(window), border, lambda a: np.median(view(a, window), axis=(3, 4, 5)))


def _windows(image: np.ndarray, window: Shape, border: str) -> np.ndarray:
    padded = np.pad(image, [(n // 2, n // 2) for n in window], mode=PAD[border])
    return np.lib.stride_tricks.sliding_window_view(padded, window)


def median_filter_dense(stack: DataFrame, window: Shape, border: str = "reflect") -> DataFrame:
    return dense(stack, lambda image: np.median(_windows(image, window, border), axis=(3, 4, 5)))


def convolve_dense(stack: DataFrame, kernel: np.ndarray, border: str = "zero") -> DataFrame:
    kernel = _cube(kernel)
    return dense(stack, lambda image: np.einsum("abcijk,ijk->abc", _windows(image, kernel.shape, border), kernel))
