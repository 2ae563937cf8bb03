"""Stacks made from indices alone, for a given table of images."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..model import Shape, exploded, grid, offset


def fill_stack(images: DataFrame, shape: Shape, value: float) -> DataFrame:
    """A constant image for each row of images."""
    return images.withColumns(
        {**{c: F.lit(n) for c, n in zip("dhw", shape, strict=True)}, "values": F.array_repeat(F.lit(float(value)), math.prod(shape))}
    )


def iwise(images: DataFrame, shape: Shape, value) -> DataFrame:
    """Pixels whose value is a function of the index: value(batch, z, y, x), all columns. images has `batch`."""
    return grid(images, shape).withColumn("v", value(F.col("batch"), F.col("z"), F.col("y"), F.col("x")))


def _place(shape: Shape):
    d, h, w = shape
    return lambda b, z, y, x: b * (d * h * w) + offset(z, y, x, h, w)


def arange_stack(images: DataFrame, shape: Shape, start: float = 0.0, step: float = 1.0) -> DataFrame:
    """start + place * step over the whole stack, images in order of `batch`."""
    at = _place(shape)
    return iwise(images, shape, lambda b, z, y, x: F.lit(start) + at(b, z, y, x) * step)


def linspace_stack(images: DataFrame, n_images: int, shape: Shape, start: float, stop: float, endpoint: bool = True) -> DataFrame:
    """n_images * size values evenly from start to stop; with endpoint the last one is stop itself."""
    n = n_images * math.prod(shape)
    step = (stop - start) / max(1, n - endpoint)
    at = _place(shape)

    def value(b: Column, z: Column, y: Column, x: Column) -> Column:
        k = at(b, z, y, x)
        even = F.lit(start) + k * step
        return F.when(k == n - 1, F.lit(float(stop))).otherwise(even) if endpoint else even

    return iwise(images, shape, value)


def iota_tiled(images: DataFrame, shape: Shape, tile: Shape, tile_batch: int = 1) -> DataFrame:
    """The place, within the tile, of the index modulo the tile."""
    d, h, w = tile
    return iwise(
        images, shape, lambda b, z, y, x: ((b % tile_batch) * (d * h * w) + offset(z % d, y % h, x % w, h, w)).cast("double")
    )


#: A Poisson value of a larger mean is the sum of values of at most this mean.
POISSON_MEAN = 8.0


def poisson_table(mean: float) -> list[float]:
    """P(value <= k) for k = 0, 1, .. as far as double tells it from 1."""
    term = total = math.exp(-mean)
    out, k = [total], 0
    while total < 1 - 1e-15 and term > 1e-18:
        k += 1
        term *= mean / k
        total += term
        out.append(total)
    return out


def uniform_draw(seed: int, image: Column, place: Column, stream: int) -> Column:
    """A number strictly between 0 and 1: 52 bits of the md5 of seed, image, place and stream."""
    name = F.concat_ws(":", F.lit(str(seed)), image.cast("string"), place.cast("string"), F.lit(str(stream)))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _count_below(table: Column, u: Column) -> Column:
    return F.size(F.filter(table, lambda v: v < u))


def random_stack(images: DataFrame, shape: Shape, kind: str, a: float, b: float = 0.0, seed: int = 1) -> DataFrame:
    """Uniform(a, b), normal(mean a, deviation b), lognormal (of that normal) or poisson(mean a) values.

    Each value follows from the image's id, its place and the seed alone, so a repeated task makes the same ones, and
    any engine with md5 can make them too."""
    draw = lambda p, stream: uniform_draw(seed, F.col("image_id"), p, stream)

    def value(p: Column) -> Column:
        if kind == "uniform":
            return F.lit(float(a)) + draw(p, 0) * float(b - a)
        if kind in ("normal", "lognormal"):
            x = F.lit(float(a)) + F.sqrt(-2 * F.log(draw(p, 0))) * F.cos(2 * math.pi * draw(p, 1)) * float(b)
            return F.exp(x) if kind == "lognormal" else x
        if kind == "poisson":
            parts = max(1, math.ceil(a / POISSON_MEAN))
            table = F.array(*[F.lit(v) for v in poisson_table(a / parts)])
            counts = [_count_below(table, draw(p, k)) for k in range(parts)]
            return sum(counts[1:], counts[0]).cast("double")
        raise ValueError(f"unknown distribution {kind}")

    places = F.sequence(F.lit(0), F.lit(math.prod(shape) - 1))
    return images.select(F.col("image_id").cast("long")).select(
        "image_id", *[F.lit(n).cast("int").alias(c) for c, n in zip("dhw", shape, strict=True)], F.transform(places, value).alias("values")
    )


def window_taps(kind: str, n: int, param: float = 0.0) -> Column:
    """Column of tap i (a column named `i`) of a full window of n taps: gaussian(param = deviation), blackman,
    sinc(param = cutoff)."""
    center = n // 2 - (0.5 if n % 2 == 0 else 0.0)
    i, u = F.col("i"), F.col("i") - F.lit(center)
    if kind == "gaussian":
        return F.exp(-(u * u) / (2 * param * param))
    if kind == "blackman":
        t = 2 * math.pi * i / (n - 1)
        return 0.42 - 0.5 * F.cos(t) + 0.08 * F.cos(2 * t)
    if kind == "sinc":
        return F.when(u == 0, F.lit(param)).otherwise(F.sin(math.pi * param * u) / F.when(u != 0, math.pi * u))
    raise ValueError(f"unknown window {kind}")


def window(lines: DataFrame, kind: str, n: int, param: float = 0.0, half: bool = False, normalize: bool = False) -> DataFrame:
    """For each row of lines: i, v of the window's taps; half starts at n // 2. Normalizing divides by the sum of
    the full window, so a half window is the full one's second half."""
    taps = exploded(lines.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))))
    taps = taps.withColumn("v", window_taps(kind, n, param))
    if normalize:
        taps = taps.withColumn("v", F.col("v") / F.sum("v").over(W.partitionBy(*lines.columns)))
    return taps.filter(F.col("i") >= n // 2).withColumn("i", F.col("i") - n // 2) if half else taps


def edge(distance: Column, smoothness: Column) -> Column:
    """1 inside (distance <= 0), 0 beyond smoothness, a raised cosine between."""
    inside = F.when(distance <= 0, 1.0)
    return inside.when(distance >= smoothness, 0.0).otherwise(0.5 + 0.5 * F.cos(math.pi * distance / F.when(smoothness > 0, smoothness)))


def mask_value(shape: str, has_z: bool = False) -> Column:
    """The mask over columns z, y, x, cz, cy, cx, rz, ry, rx, smoothness, cvalue, invert (3-d if has_z)."""
    axes = ("z", "y", "x") if has_z else ("y", "x")
    at = {a: F.col(a) - F.col(f"c{a}") for a in axes}
    smooth = F.col("smoothness")
    norm = lambda parts: F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    if shape == "sphere":
        mask = edge(norm(list(at.values())) - F.col("rx"), smooth)
    elif shape == "ellipse":
        r = norm(list(at.values()))
        scaled = norm([at[a] / F.col(f"r{a}") for a in axes])
        # the distance to the border along the line through the center
        border = F.when(scaled > 0, r / F.when(scaled > 0, scaled)).otherwise(F.col("rx"))
        mask = F.when(scaled <= 1, 1.0).otherwise(edge(r - border, smooth))
    elif shape == "rectangle":
        mask = F.lit(1.0)
        for a in axes:
            mask = mask * edge(F.abs(at[a]) - F.col(f"r{a}"), smooth)
    elif shape == "cylinder" and has_z:
        mask = edge(norm([at["y"], at["x"]]) - F.col("rx"), smooth) * edge(F.abs(at["z"]) - F.col("rz"), smooth)
    else:
        raise ValueError(f"unknown shape {shape}")
    return F.when(F.col("invert"), 1 - mask).otherwise(mask) * F.col("cvalue")


def draw_mask(pixels: DataFrame, masks: DataFrame, shape: str, has_z: bool = False, operator=None) -> DataFrame:
    """operator(v, mask) of each pixel, their product by default; masks: image_id, center, radii, smoothness, cvalue,
    invert, and matrix if shapes are moved (3 x 4 in z, y, x order, inverse: from a pixel to the shape's own frame)."""
    joined = pixels.join(masks, "image_id")
    if "matrix" in masks.columns:
        own = {a: sum((F.get("matrix", F.lit(4 * i + j)) * F.col(b) for j, b in enumerate("zyx")), F.get("matrix", F.lit(4 * i + 3))) for i, a in enumerate("zyx")}
        joined = joined.withColumns({f"_{a}": F.col(a) for a in "zyx"}).withColumns(own)
        value = mask_value(shape, has_z)
        held = joined.withColumn("_mask", value).withColumns({a: F.col(f"_{a}") for a in "zyx"})
    else:
        held = joined.withColumn("_mask", mask_value(shape, has_z))
    v, mask = F.col("v"), F.col("_mask")
    return held.withColumn("v", operator(v, mask) if operator else v * mask).select(*pixels.columns)


def mask_stack(images: DataFrame, masks: DataFrame, extent: Shape, shape: str, has_z: bool = False) -> DataFrame:
    """Pixels of the masks alone, for a table of images."""
    ones = exploded(grid(images.select("image_id"), extent).withColumn("v", F.lit(1.0)))
    return draw_mask(ones, masks, shape, has_z)
