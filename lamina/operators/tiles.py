"""Neighbourhoods of images that don't fit a row: tiles with halos.

Every pixel goes to its tile and to those whose halo it lies in, so a shuffle moves little more than the pixels once, whatever
the size of the window. A task holds one tile with its halo, fills in the border and works on it in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.borders import border_places
from ..model import AXES, Shape, exploded
from .dense import pieces

#: Pixels of a tile, about, without its halo.
TILE_PIXELS = 1 << 14


def tile_shape(shape: Shape, halo: Shape, tile_pixels: int = TILE_PIXELS) -> Shape:
    """Equal edges along the axes that are longer than 1, at least as long as their halo."""
    edge = round(tile_pixels ** (1 / max(1, sum(n > 1 for n in shape))))
    return tuple(min(n, max(edge, h)) for n, h in zip(shape, halo, strict=True))


def tile_entries(pixels: DataFrame, shape: Shape, halo: Shape, border: str, tile: Shape, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """image_id, tz, ty, tx, entries: the pixels of each tile and its halo, by their place in it."""
    placed = pixels.select("image_id", *[F.col(a).cast("long").alias(a) for a in AXES], *[F.col(c).cast("double").alias(c) for c in values])
    place = F.lit(0).cast("long")
    for a, n, t, h in zip(AXES, shape, tile, halo, strict=True):
        if border == "periodic" and h:  # what a halo beyond the edge holds comes from the other side
            seen = F.array_compact(F.array(F.col(a), F.when(F.col(a) >= n - h, F.col(a) - n), F.when(F.col(a) < h, F.col(a) + n)))
            placed = exploded(placed.withColumn(a, F.explode(seen)))
        last = (n - 1) // t
        at = F.col(a)
        if h and last:
            tiles = F.sequence(F.greatest(F.lit(0), F.floor((at - h) / t)), F.least(F.lit(last), F.floor((at + h) / t)))
            placed = exploded(placed.withColumn(f"t{a}", F.explode(tiles)))
        else:
            placed = placed.withColumn(f"t{a}", F.greatest(F.lit(0), F.least(F.lit(last), F.floor(at / t))).cast("long"))
        place = place * (t + 2 * h) + (F.col(a) - F.col(f"t{a}") * t + h)
    return placed.groupBy("image_id", *[f"t{a}" for a in AXES]).agg(F.collect_list(F.struct(place.alias("place"), *values)).alias("entries"))


def tiled(pixels: DataFrame, shape: Shape, halo: Shape, border: str, function: Callable[[np.ndarray], np.ndarray], reached: Callable[[np.ndarray], np.ndarray] | None = None, tile_pixels: int = TILE_PIXELS, tile: Shape | None = None) -> DataFrame:
    """image_id, z, y, x, v: function of each pixel's surroundings. function takes an array with `halo` elements more on each side
    and returns one without them. Absent pixels are 0; they have rows only where reached, which takes such an array of which pixels are
    present, says so. halo may not exceed a periodic axis. A `tile` of one's own may be no shorter than its halo or the axis."""
    if border == "periodic" and any(h > n for h, n in zip(halo, shape, strict=True)):
        raise ValueError("a window reaches around a periodic axis more than once")
    tile = tile or tile_shape(shape, halo, tile_pixels)
    region = tuple(t + 2 * h for t, h in zip(tile, halo, strict=True))

    def one(at: tuple[int, ...], places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        held, there = np.zeros(region), np.zeros(region, bool)
        held.ravel()[places], there.ravel()[places] = values, True
        starts = [k * t for k, t in zip(at, tile, strict=True)]
        sizes = [min(t, n - s) for t, n, s in zip(tile, shape, starts, strict=True)]
        for axis, (n, h, s, size) in enumerate(zip(shape, halo, starts, sizes, strict=True)):
            wanted = np.arange(s - h, s + size + h)
            source = wanted if border == "periodic" else border_places(wanted, n, border)
            from_ = source - (s - h)
            held, there = (np.take(x, np.clip(from_, 0, None), axis) for x in (held, there))
            if border in ("zero", "value"):
                outside = tuple(np.flatnonzero(source < 0) if k == axis else slice(None) for k in range(3))
                held[outside], there[outside] = 0, False
        where = np.nonzero(reached(there) if reached else there[tuple(slice(h, h + size) for h, size in zip(halo, sizes, strict=True))])
        return function(held)[where], [w + s for w, s in zip(where, starts, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "entries"):
            for k in range(batch.num_rows):
                entries = batch.column("entries")[k].values
                at = tuple(batch.column(f"t{a}")[k].as_py() for a in AXES)
                found, index = one(at, entries.field("place").to_numpy(), entries.field("v").to_numpy(zero_copy_only=False))
                image = pa.array([batch.column("image_id")[k].as_py()] * len(found), batch.column("image_id").type)
                yield pa.RecordBatch.from_arrays([image, *[pa.array(i.astype(np.int64)) for i in index], pa.array(found.astype(np.float64))], ["image_id", *AXES, "v"])

    kind = pixels.schema["image_id"].dataType.simpleString()
    return tile_entries(pixels, shape, halo, border, tile).mapInArrow(run, f"image_id {kind}, z long, y long, x long, v double")


def in_batches(rows: Iterator[tuple[list, list[np.ndarray]]], schema: pa.Schema, limit: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Record batches of about `limit` rows from small parts: of each the values that all its rows share, then their arrays."""
    shared, arrays, counts = [], [], []

    def batch() -> pa.RecordBatch:
        index = pa.array(np.repeat(np.arange(len(counts)), counts))
        n = len(shared[0])
        same = [pa.array([s[k] for s in shared], schema.field(k).type).take(index) for k in range(n)]
        own = [pa.array(np.concatenate([a[k] for a in arrays]), schema.field(n + k).type) for k in range(len(arrays[0]))]
        return pa.RecordBatch.from_arrays([*same, *own], schema=schema)

    held = 0
    for values, parts in rows:
        if len(parts[0]):
            shared.append(values)
            arrays.append(parts)
            counts.append(len(parts[0]))
            held += counts[-1]
        if held >= limit:
            yield batch()
            shared, arrays, counts, held = [], [], [], 0
    if held:
        yield batch()
