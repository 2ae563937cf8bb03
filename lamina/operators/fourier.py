"""Discrete Fourier transforms and the arithmetic of their layouts.

Dense: one image a row through numpy, no shuffle. Relational: a direct transform, axis by axis, for lines
that don't fit a row. Spectra are tables of integer frequencies; the half layout holds kx >= 0 only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FREQUENCIES, Shape, exploded, frequency, frequency_index
from .dense import arrays, listed, pieces, scatter, shapes

NORMS = ("forward", "ortho", "backward")
CORE = ["image_id", "d", "h", "w"]


def _rows(images: DataFrame, held: list[str], made: list[str], function) -> DataFrame:
    """Each row's arrays `held` through function(shape, *arrays), which returns the arrays `made`; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, held[0]):
            each = zip(shapes(batch), *(arrays(batch, c) for c in held), strict=True)
            found = [[a.ravel() for a in function(*row)] for row in each]
            columns = [listed(list(c)) for c in zip(*found, strict=True)] or [listed([]) for _ in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CORE), *columns], [*CORE, *made])

    schema = "image_id long, d int, h int, w int, " + ", ".join(f"{c} array<double>" for c in made)
    return images.select(*[F.col(c).cast("long" if c == "image_id" else "int") for c in CORE], *held).mapInArrow(run, schema)


def fft_r2c(stack: DataFrame, norm: str = "forward") -> DataFrame:
    """Real images to half spectra, dense: image_id, logical d, h, w, re, im (row-major over d, h, w // 2 + 1)."""

    def one(shape, values):
        s = np.fft.rfftn(values.reshape(shape), norm=norm)
        return s.real, s.imag

    return _rows(stack, ["values"], ["re", "im"], one)


def fft_c2r(spectra: DataFrame, norm: str = "forward") -> DataFrame:
    """Dense half spectra back to real images."""

    def one(shape, re, im):
        s = (re + 1j * im).reshape(shape[0], shape[1], shape[2] // 2 + 1)
        return (np.fft.irfftn(s, s=shape, axes=(0, 1, 2), norm=norm),)

    return _rows(spectra, ["re", "im"], ["values"], one)


def fft_c2c(spectra: DataFrame, inverse: bool = False, norm: str = "forward") -> DataFrame:
    """Dense complex images (re, im over d, h, w) to full spectra, or back."""

    def one(shape, re, im):
        s = (np.fft.ifftn if inverse else np.fft.fftn)((re + 1j * im).reshape(shape), norm=norm)
        return s.real, s.imag

    return _rows(spectra, ["re", "im"], ["re", "im"], one)


def to_frequencies(spectra: DataFrame, shape: Shape, half: bool = True) -> DataFrame:
    """Dense spectra as rows image_id, kz, ky, kx, re, im."""
    d, h, w = shape
    n = w // 2 + 1 if half else w
    flat = exploded(spectra.select("image_id", F.posexplode(F.arrays_zip("re", "im")).alias("p", "c")))
    p = F.col("p").cast("long")
    z, y, x = F.floor(p / (h * n)).cast("long"), F.floor(p / n).cast("long") % h, p % n
    return flat.select(
        "image_id",
        frequency(z, d).alias("kz"),
        frequency(y, h).alias("ky"),
        (x if half else frequency(x, w)).alias("kx"),
        F.col("c.re").alias("re"),
        F.col("c.im").alias("im"),
    )


def from_frequencies(spectrum: DataFrame, shape: Shape) -> DataFrame:
    """Half spectra as dense rows; absent frequencies are 0."""
    d, h, w = shape
    n = w // 2 + 1
    place = (frequency_index(F.col("kz"), d) * h + frequency_index(F.col("ky"), h)) * n + F.col("kx")
    held = spectrum.groupBy("image_id").agg(F.collect_list(F.struct(place.cast("long").alias("place"), "re", "im")).alias("entries"))
    rows = held.select("image_id", *[F.lit(v).cast("int").alias(c) for c, v in zip("dhw", shape, strict=True)], "entries")
    return scatter(rows, d * h * n, ("re", "im"), ["image_id", "d", "h", "w"])


def dft_join(pixels: DataFrame, shape: Shape, norm: str = "forward") -> DataFrame:
    """The half spectrum by a direct transform, one axis after another: each value is spread over the axis's
    frequencies and summed per frequency, so lines of any length are plain grouped sums."""
    out = pixels.select("image_id", "z", "y", "x", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    for axis, k, n in (("x", "kx", shape[2]), ("y", "ky", shape[1]), ("z", "kz", shape[0])):
        last = n // 2 if k == "kx" else n - 1
        spread = exploded(out.withColumn(k, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))))
        angle = F.lit(-2 * math.pi / n) * ((F.col(axis) * F.col(k)) % n)
        c, s = F.cos(angle), F.sin(angle)
        keys = [x for x in spread.columns if x not in (axis, "re", "im")]
        out = spread.groupBy(*keys).agg(
            F.sum(F.col("re") * c - F.col("im") * s).alias("re"), F.sum(F.col("re") * s + F.col("im") * c).alias("im")
        )
    size = math.prod(shape)
    scale = {"forward": 1 / size, "ortho": 1 / math.sqrt(size), "backward": 1.0}[norm]
    return out.select(
        "image_id", frequency(F.col("kz"), shape[0]).alias("kz"), frequency(F.col("ky"), shape[1]).alias("ky"), "kx",
        (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"),
    )


def _factors(n: int) -> tuple[int, int]:
    """n as a product of two numbers that are as near as can be, the lesser first."""
    low = next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0)
    return low, n // low


def _short(lines: DataFrame, core: list[str], size: int, twiddle: tuple[str, int] | None = None) -> DataFrame:
    """core, k, re, im: transforms of lines of `size` values, each gathered from rows (core, at, re, im). twiddle (column, n)
    multiplies what has frequency k by exp(-2 pi i k column / n)."""
    held = lines.groupBy(*core).agg(F.collect_list(F.struct("at", "re", "im")).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "entries"):
            out = []
            for row in range(batch.num_rows):
                entries = batch.column("entries")[row].values
                line = np.zeros(size, complex)
                re, im = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("re", "im"))
                line[entries.field("at").to_numpy()] = re + 1j * im
                found = np.fft.fft(line)
                if twiddle:
                    step = batch.column(twiddle[0])[row].as_py() * np.arange(size) % twiddle[1]
                    found = found * np.exp(-2j * np.pi * step / twiddle[1])
                out.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in core), listed([x.real for x in out]), listed([x.imag for x in out])], [*core, "re", "im"])

    schema = held.select(*core, *[F.expr("cast(array() as array<double>)").alias(c) for c in ("re", "im")]).schema
    flat = held.mapInArrow(run, schema).select(*core, F.posexplode(F.arrays_zip("re", "im")).alias("k", "c"))
    return exploded(flat.select(*core, F.col("k").cast("long").alias("k"), "c.re", "c.im"))


def _long(rows: DataFrame, others: list[str], axis: str, into: str, n: int) -> DataFrame:
    """One axis of complex rows transformed. With n = a * b, value j = b * j1 + j2 and frequency k = k1 + a * k2: lines of a values
    (over j1) for each j2, twiddles, a shuffle that turns rows into columns, and lines of b values (over j2) for each k1."""
    a, b = _factors(n)
    first = rows.select(*others, (F.col(axis) % b).alias("_j"), F.floor(F.col(axis) / b).cast("long").alias("at"), "re", "im")
    if a > 1:
        first = _short(first, [*others, "_j"], a, ("_j", n)).withColumnRenamed("k", "_k")
    else:
        first = first.withColumn("_k", F.lit(0).cast("long"))
    second = first.select(*others, "_k", F.col("_j").alias("at"), "re", "im")
    return _short(second, [*others, "_k"], b).select(*others, (F.col("_k") + a * F.col("k")).alias(into), "re", "im")


def dft_factored(pixels: DataFrame, shape: Shape, norm: str = "forward") -> DataFrame:
    """The half spectrum of images whose lines don't fit a row, as dft_join gives it, with n log n work and two shuffles of n values an
    axis. A task holds one line of the longer factor: about the root of n, all of it only where n is prime."""
    out = pixels.select("image_id", "z", "y", "x", F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    for axis, k, n in (("x", "kx", shape[2]), ("y", "ky", shape[1]), ("z", "kz", shape[0])):
        others = [c for c in out.columns if c not in (axis, "re", "im")]
        out = _long(out, others, axis, k, n) if n > 1 else out.withColumnRenamed(axis, k)
        if k == "kx":
            out = out.filter(F.col("kx") <= n // 2)
    size = math.prod(shape)
    scale = {"forward": 1 / size, "ortho": 1 / math.sqrt(size), "backward": 1.0}[norm]
    kz, ky = (frequency(F.col(k), n).alias(k) for k, n in (("kz", shape[0]), ("ky", shape[1])))
    return out.select("image_id", kz, ky, "kx", (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def mirrored(k: Column, n: int) -> Column:
    """-k as a frequency of an axis of n: an even axis's Nyquist is its own mirror."""
    return F.when((-k) * 2 == n, k).otherwise(-k)


def half_to_full(spectrum: DataFrame, shape: Shape) -> DataFrame:
    """Every frequency of an axis of n between -(n // 2) and (n - 1) // 2, by conjugate mirrors.

    An even width's Nyquist column, kx = w / 2 in the half layout, is kx = -w / 2 in the full one."""
    d, h, w = shape
    own = spectrum.withColumn("kx", F.when(F.col("kx") * 2 == w, -F.col("kx")).otherwise(F.col("kx")))
    inner = spectrum.filter((F.col("kx") > 0) & (F.col("kx") * 2 != w))
    mirror = inner.withColumns(
        {"kz": mirrored(F.col("kz"), d), "ky": mirrored(F.col("ky"), h), "kx": -F.col("kx"), "im": -F.col("im")}
    )
    return own.unionByName(mirror)


def full_to_half(spectrum: DataFrame, shape: Shape) -> DataFrame:
    """The rows with kx >= 0, an even width's Nyquist as kx = w / 2."""
    w = shape[2]
    kept = spectrum.filter((F.col("kx") >= 0) | (F.col("kx") * 2 == -w))
    return kept.withColumn("kx", F.when(F.col("kx") * 2 == -w, -F.col("kx")).otherwise(F.col("kx")))


def remap(spectrum: DataFrame, shape: Shape, source: str, target: str) -> DataFrame:
    """Between the layouts h, hc, f, fc: the rows of the target, with the index (iz, iy, ix) each has there."""
    rows = spectrum
    if source[0] == "h" and target[0] == "f":
        rows = half_to_full(rows, shape)
    elif source[0] == "f" and target[0] == "h":
        rows = full_to_half(rows, shape)
    centered = target.endswith("c")
    at = {f"i{k[1]}": frequency_index(F.col(k), n, centered) for k, n in zip(FREQUENCIES, shape, strict=True)}
    if target[0] == "h":
        at["ix"] = F.col("kx")
    return rows.withColumns(at)


def fft_resize(spectrum: DataFrame, shape: Shape, target: Shape, correct_nyquist: bool = False) -> DataFrame:
    """A half spectrum cropped to the target's frequencies; what padding adds is 0 and has no rows.

    correct_nyquist: where cropping makes an even axis's Nyquist of a frequency that was an inner one, the
    value there is the mean of it and its mirror's conjugate."""
    kept = spectrum
    for k, n, m in zip(FREQUENCIES[:2], shape, target, strict=False):
        if m < n:
            kept = kept.filter(F.col(k).between(-(m // 2), (m - 1) // 2))
    if target[2] < shape[2]:
        kept = kept.filter(F.col("kx") <= target[2] // 2)
    axes = [(k, m) for k, n, m in zip(FREQUENCIES, shape, target, strict=True) if m < n and m % 2 == 0]
    if not correct_nyquist or not axes:
        return kept
    on = F.lit(False)
    for k, m in axes:
        on = on | (F.abs(F.col(k)) * 2 == m)
    # the partner of a frequency on the new Nyquist: the mirror, taken from the source
    kx_sign = F.when(F.col("kx") > 0, F.lit(1)).otherwise(F.lit(0))
    flipped = spectrum.filter(on).select("image_id", (-F.col("kz")).alias("kz"), (-F.col("ky")).alias("ky"), F.col("kx"), F.col("re").alias("_re"), (-F.col("im")).alias("_im"), kx_sign.alias("_s"))
    joined = kept.join(flipped.drop("_s"), ["image_id", *FREQUENCIES], "left")
    both = on & F.col("_re").isNotNull() & (F.col("kx") * 2 % target[2] == 0)
    return joined.select(
        "image_id", *FREQUENCIES,
        F.when(both, (F.col("re") + F.col("_re")) / 2).otherwise(F.col("re")).alias("re"),
        F.when(both, (F.col("im") + F.col("_im")) / 2).otherwise(F.col("im")).alias("im"),
    )
