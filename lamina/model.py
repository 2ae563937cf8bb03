"""The data model.

stack     image_id, d, h, w, values array<double> (row-major) and any metadata: one row per image
pixels    image_id, z, y, x, v and any metadata: one row per element
spectrum  image_id, kz, ky, kx, re, im: one row per integer frequency (the half layout has kx >= 0 only)
shells    image_id, shell, value (or re, im), weight: one row per shell of frequencies

Layouts of spectra are index arithmetic over the same rows. Pixels are never null: a reader drops rows without
values. All computing is in double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Shape = tuple[int, int, int]
AXES = ("z", "y", "x")
FREQUENCIES = ("kz", "ky", "kx")


def offset(z: Column, y: Column, x: Column, h, w) -> Column:
    """Row-major place of an index."""
    return (z * h + y) * w + x


def index_of(place: Column, h, w) -> dict[str, Column]:
    """The index at a row-major place."""
    h, w = [c if isinstance(c, Column) else F.lit(c) for c in (h, w)]
    return {
        "z": F.floor(place / (h * w)).cast("long"),
        "y": F.floor(place / w).cast("long") % h,
        "x": place.cast("long") % w,
    }


def metadata(df: DataFrame, *core: str) -> list[str]:
    """The columns of df besides the core ones."""
    return [c for c in df.columns if c not in core]


def exploded(df: DataFrame) -> DataFrame:
    """df, whose rows an explode has just made. The estimate of its size doesn't count them, so a join would send it to all tasks
    at any size: it is to be sorted and merged, where the other side isn't sent by its own hint."""
    return df.hint("merge")


def grid(images: DataFrame, shape: Shape) -> DataFrame:
    """Every index of `shape` for each row of images."""
    out = images
    for axis, n in zip(AXES, shape, strict=True):
        out = out.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return out


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns added that are computed once a row, however often later expressions use them: the optimizer puts
    a column's expression into all that use it, but never across an explode, here of one struct."""
    held = df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once"))
    return held.select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])


def frequency(index: Column, n: int, centered: bool = False) -> Column:
    """Integer frequency of an index along an axis of n."""
    return index - n // 2 if centered else F.when(index < (n + 1) // 2, index).otherwise(index - n)


def frequency_index(k: Column, n: int, centered: bool = False) -> Column:
    """Index of an integer frequency along an axis of n."""
    return k + n // 2 if centered else F.when(k < 0, k + n).otherwise(k)


def fftfreq(shape: Shape) -> dict[str, Column]:
    """Normalized frequencies (cycles a pixel) of kz, ky, kx."""
    return {k: F.col(k) / float(n) for k, n in zip(FREQUENCIES, shape, strict=True)}


def norm_fftfreq(shape: Shape) -> Column:
    f = fftfreq(shape)
    return F.sqrt(f["kz"] * f["kz"] + f["ky"] * f["ky"] + f["kx"] * f["kx"])
