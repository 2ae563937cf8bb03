"""Filters over spectra: columns over frequencies, no shuffle but to meet per-image parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import times
from ..model import FREQUENCIES, Shape, fftfreq, norm_fftfreq


def low(f: Column, cutoff: float, width: float) -> Column:
    edge = F.lit(0.0) if width == 0 else F.when(f >= cutoff + width, 0.0).otherwise(0.5 * (1 + F.cos(math.pi * (cutoff - f) / width)))
    return F.when(f <= cutoff, 1.0).otherwise(edge)


def high(f: Column, cutoff: float, width: float) -> Column:
    edge = F.lit(0.0) if width == 0 else F.when(f <= cutoff - width, 0.0).otherwise(0.5 * (1 + F.cos(math.pi * (f - cutoff) / width)))
    return F.when(f >= cutoff, 1.0).otherwise(edge)


def scaled(spectrum: DataFrame, by: Column) -> DataFrame:
    return spectrum.withColumns({"re": F.col("re") * by, "im": F.col("im") * by})


def lowpass(spectrum: DataFrame, shape: Shape, cutoff: float, width: float = 0.0) -> DataFrame:
    return scaled(spectrum, low(norm_fftfreq(shape), cutoff, width))


def highpass(spectrum: DataFrame, shape: Shape, cutoff: float, width: float = 0.0) -> DataFrame:
    return scaled(spectrum, high(norm_fftfreq(shape), cutoff, width))


def bandpass(spectrum: DataFrame, shape: Shape, first: float, last: float, first_width: float = 0.0, last_width: float = 0.0) -> DataFrame:
    """The product of the highpass at first and the lowpass at last."""
    f = norm_fftfreq(shape)
    return scaled(spectrum, high(f, first, first_width) * low(f, last, last_width))


def filter_spectrum(spectrum: DataFrame, shape: Shape, function, start: float = 0.0, stop: float = 0.5) -> DataFrame:
    """Multiply by function(fz, fy, fx) of frequencies that run from start to stop cycles a pixel instead of 0 to
    0.5; only 1-d spectra may start above 0."""
    if start and (shape[0] > 1 or shape[1] > 1):
        raise ValueError("only 1-d spectra may start above 0")
    f = {k: start + c * 2 * (stop - start) if k == "kx" else c * 2 * stop for k, c in fftfreq(shape).items()}
    return scaled(spectrum, function(*[f[k] for k in FREQUENCIES]))


def phase_shift(spectrum: DataFrame, shifts: DataFrame, shape: Shape, cutoff: float = 1.0) -> DataFrame:
    """Shift images in space: multiply by exp(-2 pi i shift . f) up to the cutoff. shifts: image_id, sz, sy, sx."""
    f = fftfreq(shape)
    joined = spectrum.join(shifts.select("image_id", "sz", "sy", "sx"), "image_id")
    angle = -2 * math.pi * (F.col("sz") * f["kz"] + F.col("sy") * f["ky"] + F.col("sx") * f["kx"])
    re, im = times((F.col("re"), F.col("im")), (F.cos(angle), F.sin(angle)))
    within = norm_fftfreq(shape) <= cutoff
    return joined.withColumns({"re": F.when(within, re).otherwise(F.col("re")), "im": F.when(within, im).otherwise(F.col("im"))}).select(*spectrum.columns)


def half_weight(w: int) -> Column:
    """How many frequencies of the full spectrum a row of the half layout stands for."""
    inner = F.col("kx") > 0
    if w % 2 == 0:
        inner = inner & (F.col("kx") * 2 != w)
    return F.when(inner, 2.0).otherwise(1.0)


def standardize(spectrum: DataFrame, shape: Shape, norm: str = "forward", half: bool = True) -> DataFrame:
    """Zero the DC and scale, so that the inverse transform has mean 0 and deviation 1."""
    weight = half_weight(shape[2]) if half else F.lit(1.0)
    dc = (F.col("kz") == 0) & (F.col("ky") == 0) & (F.col("kx") == 0)
    energy = spectrum.groupBy("image_id").agg(F.sum(F.when(~dc, weight * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))).otherwise(0.0)).alias("_e"))
    n = math.prod(shape)
    scale = {"forward": 1.0, "ortho": math.sqrt(n), "backward": float(n)}[norm]
    factor = F.when(dc, 0.0).otherwise(F.try_divide(F.lit(scale), F.sqrt("_e")))
    return scaled(spectrum.join(energy, "image_id"), factor).select(*spectrum.columns)
