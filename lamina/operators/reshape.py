"""Between stacks and pixels, and what only renames, moves or drops indices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import AXES, Shape, exploded, grid, index_of, metadata, offset
from .dense import scatter

CORE = ("image_id", "d", "h", "w", "values")


def stack_to_pixels(stack: DataFrame) -> DataFrame:
    """One row per element: image_id, metadata, z, y, x, v. Narrow."""
    others = metadata(stack, *CORE)
    flat = stack.select("image_id", "h", "w", *others, F.posexplode("values").alias("_place", "v"))
    at = index_of(F.col("_place"), F.col("h"), F.col("w"))
    return exploded(flat.select("image_id", *others, *[at[a].alias(a) for a in AXES], "v"))


def pixels_to_stack(pixels: DataFrame, shape: Shape, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per image; absent pixels are 0. `keep` names columns that are constant in an image."""
    d, h, w = shape
    place = offset(F.col("z"), F.col("y"), F.col("x"), h, w)
    held = pixels.groupBy("image_id").agg(
        F.collect_list(F.struct(place.alias("place"), F.col("v").cast("double").alias("values"))).alias("entries"),
        *[F.first(c).alias(c) for c in keep],
    )
    rows = held.select("image_id", *[F.lit(n).alias(c) for c, n in zip("dhw", shape, strict=True)], *keep, "entries")
    return scatter(rows, d * h * w, ("values",), ["image_id", "d", "h", "w", *keep])


def reshape(stack: DataFrame, shape: Shape) -> DataFrame:
    """The same values under another shape; an image of another size is an error."""
    size = math.prod(shape)
    fits = F.when(F.size("values") == size, F.col("values")).otherwise(F.raise_error(F.lit(f"an image does not have {size} values")).cast("array<double>"))
    return stack.withColumns({"values": fits, **{c: F.lit(n) for c, n in zip("dhw", shape, strict=True)}})


def flat(stack: DataFrame) -> DataFrame:
    """Every image as one line."""
    return stack.withColumns({"w": F.size("values"), "d": F.lit(1), "h": F.lit(1)})


def permute(pixels: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Axes in another order: the new z, y, x are the axes that `order` names. Four names, image_id among them, are the new
    image_id, z, y, x; columns that describe the old images go then."""
    axes = AXES if len(order) == 3 else ("image_id", *AXES)
    if sorted(order) != sorted(axes):
        raise ValueError("order must name each axis once")
    moved = {new: F.col(old) for new, old in zip(axes, order, strict=True)}
    return pixels.withColumns(moved) if axes == AXES else pixels.select(*[c.alias(n) for n, c in moved.items()], "v")


def broadcast_stack(pixels: DataFrame, shape: Shape, target: Shape) -> DataFrame:
    """Axes of size 1 repeated to the target's size."""
    out = pixels
    for axis, n, m in zip(AXES, shape, target, strict=True):
        if n not in (1, m):
            raise ValueError(f"axis {axis} of size {n} does not fit {m}")
        if n != m:
            out = out.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    return exploded(out)


def _slice(spec, n: int) -> tuple[int, int, int]:
    """start, end, step of one axis of size n, as numpy reads it."""
    if isinstance(spec, int):
        if not -n <= spec < n:
            raise IndexError(f"index {spec} is out of bounds for size {n}")
        at = spec % n
        return at, at + 1, 1
    start, end, step = spec.start, spec.stop, 1 if spec.step is None else spec.step
    if step <= 0:
        raise ValueError("steps must be positive")
    clamp = lambda v: min(max(v + n if v < 0 else v, 0), n)
    return clamp(0 if start is None else start), clamp(n if end is None else end), step


def subregion(pixels: DataFrame, shape: Shape, *spec) -> DataFrame:
    """The pixels that a numpy-like index selects (integers, slices, one Ellipsis), numbered from 0."""
    spec = list(spec)
    if Ellipsis in spec:
        k = spec.index(Ellipsis)
        spec[k : k + 1] = [slice(None)] * (len(shape) - len(spec) + 1)
    spec += [slice(None)] * (len(shape) - len(spec))
    out = pixels
    for axis, part, n in zip(AXES, spec, shape, strict=True):
        start, end, step = _slice(part, n)
        c = F.col(axis)
        out = out.filter((c >= start) & (c < end) & ((c - start) % step == 0)).withColumn(axis, F.floor((c - start) / step).cast("long"))
    return out


def copy_batches(stack: DataFrame, picks: DataFrame) -> DataFrame:
    """Images in the order of picks (out_pos, image_id), repeats allowed; an id that isn't there is an error."""
    found = picks.join(stack.withColumn("_there", F.lit(True)), "image_id", "left")
    there = F.when(F.col("_there"), F.col("out_pos")).otherwise(F.raise_error(F.lit("an image is out of range")).cast("long"))
    return found.withColumn("out_pos", there).drop("_there").withColumnRenamed("image_id", "source_id").withColumnRenamed("out_pos", "image_id")


#: Value ranges of the integer types, unsigned ones held in the next wider signed type.
RANGES = {
    "int8": ("byte", -128, 127),
    "uint8": ("short", 0, 255),
    "int16": ("short", -32768, 32767),
    "uint16": ("int", 0, 65535),
    "int32": ("int", -(2**31), 2**31 - 1),
    "uint32": ("long", 0, 2**32 - 1),
}


def cast_value(v: Column, dtype: str, clamp: bool = True) -> Column:
    """v in another type: truncated toward 0, clamped to the range if asked (else out of range is null); NaN is 0."""
    if dtype in ("float32", "float64"):
        return v.cast("float" if dtype == "float32" else "double")
    kind, lo, hi = RANGES[dtype]
    whole = F.when(F.isnan(v), 0.0).otherwise(v)
    if clamp:
        whole = F.least(F.greatest(whole, F.lit(float(lo))), F.lit(float(hi)))
    else:
        t = F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole))
        whole = F.when((t >= lo) & (t <= hi), whole)
    return F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).cast(kind)


def cast_stack(pixels: DataFrame, dtype: str, clamp: bool = True) -> DataFrame:
    return pixels.withColumn("v", cast_value(F.col("v"), dtype, clamp))


def power(spectrum: DataFrame) -> DataFrame:
    """Complex to real: the power."""
    return spectrum.select(*[c for c in spectrum.columns if c not in ("re", "im")], (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v"))
