"""Correlation of two stacks, and Fourier shell correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import times_conjugate
from ..model import FREQUENCIES, Shape, exploded, fftfreq, norm_fftfreq

TINY = 1e-13


def score(zipped: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """cc, ncc, zcc, zncc of two stacks side by side (v and r): one aggregation of six sums. ncc and zncc are 0 where
    an image has no energy or no spread."""
    v, r = F.col("v"), F.col("r")
    sums = zipped.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.sum(v).alias("sv"), F.sum(r).alias("sr"), F.sum(v * v).alias("vv"), F.sum(r * r).alias("rr"), F.sum(v * r).alias("vr")
    )
    n, sv, sr, vv, rr, vr = (F.col(c) for c in ("n", "sv", "sr", "vv", "rr", "vr"))
    zero_mean = vr - sv * sr / n
    spread = (vv - sv * sv / n) * (rr - sr * sr / n)
    safe = lambda a, b: F.when(b > 0, a / F.sqrt(F.greatest(b, F.lit(1e-300)))).otherwise(0.0)
    return sums.select(*keys, vr.alias("cc"), safe(vr, vv * rr).alias("ncc"), (zero_mean / n).alias("zcc"), safe(zero_mean, spread).alias("zncc"))


def zip_spectra(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two spectra side by side: re, im and r_re, r_im."""
    keys = ["image_id", *FREQUENCIES]
    return left.join(right.select(*keys, F.col("re").alias("r_re"), F.col("im").alias("r_im")), keys)


def correlation_spectrum(zipped: DataFrame, mode: str = "conventional") -> DataFrame:
    """left times the conjugate of right; phase divides by the magnitude, mutual by its root, double_phase squares
    and divides by the magnitude."""
    re, im = times_conjugate((F.col("re"), F.col("im")), (F.col("r_re"), F.col("r_im")))
    out = zipped.select("image_id", *FREQUENCIES, re.alias("re"), im.alias("im"))
    re, im = F.col("re"), F.col("im")
    size = F.sqrt(re * re + im * im)
    if mode == "conventional":
        return out
    if mode == "phase":
        return out.withColumns({"re": re / (size + TINY), "im": im / (size + TINY)})
    if mode == "mutual":
        root = F.sqrt(size + TINY)
        return out.withColumns({"re": re / root, "im": im / root})
    if mode == "double_phase":
        return out.withColumns({"re": (re * re - im * im) / (size + TINY), "im": 2 * re * im / (size + TINY)})
    raise ValueError(f"unknown correlation mode {mode}")


def centered(pixels: DataFrame, shape: Shape) -> DataFrame:
    """The zero lag moved from index 0 to n // 2."""
    return pixels.withColumns({a: (F.col(a) + n // 2) % n for a, n in zip(("z", "y", "x"), shape, strict=True)})


def _vertex(middle: Column, sums: dict[int, Column], radius: int) -> tuple[Column, Column]:
    """Offset and height of the least-squares parabola through the values at -radius .. radius; a flat one keeps the middle.
    sums: of the values but the middle one, times their offset to the power 0, 1, 2."""
    n, s2, s4 = 2 * radius + 1, sum(2 * k**2 for k in range(1, radius + 1)), sum(2 * k**4 for k in range(1, radius + 1))
    total = sums[0] + middle
    a = (n * sums[2] - s2 * total) / (n * s4 - s2 * s2)
    b = sums[1] / s2
    curved = F.abs(a) >= 1e-6
    x = F.when(curved, -b / F.when(curved, 2 * a)).otherwise(0.0)
    return x, F.when(curved, (total - a * s2) / n + b * x + a * x * x).otherwise(middle)


def peak(maps: DataFrame, shape: Shape, subpixel: bool = True, max_lag: tuple[float, float, float] | None = None, radius: int = 1) -> DataFrame:
    """The largest value of each centered map within an elliptical lag, refined per axis by the least-squares parabola
    of the values up to `radius` away, which wrap around (no axis longer than 1 may be shorter than they are): image_id, z, y, x (double, centered), value (mean of the axes' heights)."""
    center = [n // 2 for n in shape]
    inside = maps
    if max_lag is not None:
        total = F.lit(0.0)
        for a, c, lag, n in zip("zyx", center, max_lag, shape, strict=True):
            if n > 1:
                total = total + F.pow((F.col(a) - c) / F.lit(float(lag)), 2)
        inside = maps.filter(total <= 1)
    d, h, w = shape
    place = (F.col("z") * h + F.col("y")) * w + F.col("x")
    best = inside.groupBy("image_id").agg(F.max(F.struct("v", (-place).alias("p"), "z", "y", "x")).alias("b"))
    best = best.select("image_id", F.col("b.v").alias("v"), *[F.col(f"b.{a}").alias(a) for a in "zyx"])
    axes = [(a, n) for a, n in zip("zyx", shape, strict=True) if n > 1]
    if not subpixel:
        return best.select("image_id", *[F.col(a).cast("double").alias(a) for a in "zyx"], F.col("v").alias("value"))
    offsets = [k for k in range(-radius, radius + 1) if k]
    steps = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("step")) for a, _ in axes for s in offsets])
    near = best.withColumn("s", F.explode(steps)).select(
        "image_id", "s.axis", "s.step", *[F.pmod(F.col(a) + F.when(F.col("s.axis") == a, F.col("s.step")).otherwise(0), F.lit(n)).alias(a) for a, n in zip("zyx", shape, strict=True)]
    )
    got = near.join(maps.select("image_id", "z", "y", "x", "v"), ["image_id", "z", "y", "x"])
    sides = got.groupBy("image_id").agg(
        *[F.sum(F.when(F.col("axis") == a, F.col("v") * F.pow(F.col("step").cast("double"), F.lit(k)))).alias(f"{a}{k}") for a, _ in axes for k in range(3)]
    )
    fitted = {a: _vertex(F.col("v"), {k: F.col(f"{a}{k}") for k in range(3)}, radius) for a, _ in axes}
    height = sum((h for _, h in list(fitted.values())[1:]), list(fitted.values())[0][1]) / len(fitted)
    return best.join(sides, "image_id").select(
        "image_id", *[(F.col(a) + fitted[a][0] if a in fitted else F.col(a).cast("double")).alias(a) for a in "zyx"], height.alias("value")
    )


def shells_of(shape: Shape, last: Column | None = None):
    """Array of (shell, weight) that a frequency falls in: linearly between the two nearest of 0 .. min(n) // 2."""
    n = min(v for v in shape if v > 1)
    radius = norm_fftfreq(shape) * n
    low = F.floor(radius).cast("long")
    part = radius - low
    high = F.least(low + 1, F.lit(n // 2).cast("long"))
    return F.array(F.struct(low.alias("shell"), (1 - part).alias("share")), F.struct(high.alias("shell"), part.alias("share")))


def _fsc(zipped: DataFrame, shape: Shape, keys: list[str]) -> DataFrame:
    within = exploded(zipped.filter(norm_fftfreq(shape) <= 0.5).withColumn("s", F.explode(shells_of(shape))))
    share = F.col("s.share")
    re, im, rr, ri = (F.col(c) for c in ("re", "im", "r_re", "r_im"))
    sums = within.groupBy(*keys, F.col("s.shell").alias("shell")).agg(
        F.sum(share * (re * rr + im * ri)).alias("c"), F.sum(share * (re * re + im * im)).alias("l"), F.sum(share * (rr * rr + ri * ri)).alias("r")
    )
    return sums.select(*keys, "shell", (F.col("c") / F.greatest(F.lit(1e-6), F.sqrt(F.col("l") * F.col("r")))).alias("value"))


def fsc_isotropic(zipped: DataFrame, shape: Shape) -> DataFrame:
    """image_id, shell, value: the correlation of two spectra (zip_spectra) in each shell."""
    return _fsc(zipped, shape, ["image_id"])


def fsc_anisotropic(zipped: DataFrame, shape: Shape, cones: list[tuple[float, float, float]], aperture: float) -> DataFrame:
    """The same within each cone about a unit direction (z, y, x), both ways, of an aperture in radians; the DC
    is in every cone."""
    f = fftfreq(shape)
    norm = norm_fftfreq(shape)
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("cone"), *[F.lit(float(v)).alias(c) for c, v in zip("zyx", cone, strict=True)]) for k, cone in enumerate(cones)])
    each = exploded(zipped.withColumn("_c", F.explode(table)))
    along = F.abs(f["kz"] * F.col("_c.z") + f["ky"] * F.col("_c.y") + f["kx"] * F.col("_c.x"))
    inside = each.filter((norm == 0) | (along >= norm * math.cos(aperture))).withColumn("cone", F.col("_c.cone"))
    return _fsc(inside, shape, ["image_id", "cone"])
