"""Resizing images, and cutting, pasting and laying out boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.borders import border_index, border_places
from ..model import AXES, Shape, exploded, grid
from .dense import PIECE
from .tiles import TILE_PIXELS, tile_entries, tile_shape

#: Copies of a tile that many boxes read from, at most.
COPIES = 16


def centered_border(shape: Shape, target: Shape) -> list[tuple[int, int]]:
    """What to add (or, below 0, to crop) before and after each axis so that n // 2 stays in place."""
    left = [m // 2 - n // 2 for n, m in zip(shape, target, strict=True)]
    return [(a, m - n - a) for a, n, m in zip(left, shape, target, strict=True)]


def resize_stack(pixels: DataFrame, images: DataFrame, shape: Shape, border: list[tuple[int, int]], mode: str = "zero", value: float = 0.0) -> DataFrame:
    """Images cropped or padded on each side. images: image_id of each image."""
    target = tuple(n + a + b for n, (a, b) in zip(shape, border, strict=True))
    out = grid(images.select("image_id"), target)
    wanted = out.select(
        "image_id",
        *[F.col(a).alias(f"o{a}") for a in AXES],
        *[border_index(F.col(a) - before, n, mode).cast("long").alias(a) for a, (before, _), n in zip(AXES, border, shape, strict=True)],
    )
    got = wanted.join(pixels.select("image_id", *AXES, "v"), ["image_id", *AXES], "left")
    outside = F.lit(value if mode == "value" else 0.0)
    return got.select("image_id", *[F.col(f"o{a}").alias(a) for a in AXES], F.coalesce("v", outside).alias("v"))


def extract_subregions(pixels: DataFrame, boxes: DataFrame, shape: Shape, box: Shape, mode: str = "zero", value: float = 0.0, tile_pixels: int = TILE_PIXELS) -> DataFrame:
    """The pixels of boxes (box_id, image_id, oz, oy, ox), numbered from each box's origin.

    mode "nothing" leaves out what lies outside the image. A range join in tiles: a box is a row for each tile that it reads
    from (and one for what it reads from none), and cuts its part out of the tile in numpy. The boxes of a crowded tile are dealt to at
    most COPIES copies of it.
    """
    border, tile = ("zero" if mode == "nothing" else mode), tile_shape(shape, (0, 0, 0), tile_pixels)
    asked = boxes.select("box_id", "image_id", *[F.col(f"o{a}").cast("long").alias(f"o{a}") for a in AXES], F.pmod(F.xxhash64("box_id"), F.lit(COPIES)).alias("copy"))
    for a, n, m, t in zip(AXES, shape, box, tile, strict=True):

        def read(k: Column) -> Column:
            return F.coalesce(F.floor(border_index(F.col(f"o{a}") + k, n, border) / t), F.lit(-1)).cast("long")  # noqa: B023

        asked = asked.withColumn(f"t{a}", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), read))))
    key = ["image_id", *[f"t{a}" for a in AXES]]
    wanted = exploded(asked.select(*key, "copy").filter(" and ".join(f"t{a} >= 0" for a in AXES)).distinct())
    tiles = tile_entries(pixels, shape, (0, 0, 0), "zero", tile).join(wanted, key)
    pairs = exploded(asked).join(tiles, [*key, "copy"], "inner" if mode == "nothing" else "left")
    outside = value if mode == "value" else 0.0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = math.prod(tile)
        step = max(1, PIECE // max(size, math.prod(box)))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            n = batch.num_rows
            numbers = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c[0] in "ot" and len(c) == 2}
            entries = batch.column("entries")
            ends = entries.offsets.to_numpy()
            cells = entries.values.slice(ends[0], ends[-1] - ends[0])
            held, there = np.full(n * size, float(outside)), np.zeros(n * size, bool)
            place = np.repeat(np.arange(n) * size, np.diff(ends)) + cells.field("place").to_numpy(zero_copy_only=False)
            held[place], there[place] = cells.field("v").to_numpy(zero_copy_only=False), True
            own, source = np.ones((n, 1, 1, 1), bool), np.arange(n).reshape(n, 1, 1, 1)
            for k, (a, m, whole, t) in enumerate(zip(AXES, box, shape, tile, strict=True)):
                form = [n if j == 0 else m if j == k + 1 else 1 for j in range(4)]
                index = border_places(numbers[f"o{a}"][:, None] + np.arange(m), whole, border)
                at = numbers[f"t{a}"][:, None]
                own = own & (np.where(index >= 0, index // t, -1) == at).reshape(form)
                source = source * t + np.where(index >= 0, index - at * t, 0).reshape(form)
            beyond = np.logical_or.reduce([numbers[f"t{a}"] < 0 for a in AXES])  # reads no tile
            source = np.where(own & ~beyond.reshape(n, 1, 1, 1), source, 0)
            if mode == "nothing":
                own = own & there[source]
            pair, *at = np.nonzero(own)
            found = np.where(beyond[pair], outside, held[source[own]])
            ids = [batch.column(c).take(pa.array(pair)) for c in ("box_id", "image_id")]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(i) for i in at), pa.array(found)], ["box_id", "image_id", *AXES, "v"])

    kinds = boxes.select("box_id", "image_id").schema
    schema = f"box_id {kinds['box_id'].dataType.simpleString()}, image_id {kinds['image_id'].dataType.simpleString()}, z long, y long, x long, v double"
    return pairs.mapInArrow(cut, schema)


def insert_subregions(pixels: DataFrame, boxed: DataFrame, boxes: DataFrame) -> DataFrame:
    """pixels with boxes written over them; where boxes overlap the last box_id wins, what lies outside is cut."""
    moved = exploded(boxed.select("box_id", *AXES, "v")).join(boxes.select("box_id", "image_id", "oz", "oy", "ox"), "box_id")
    placed = moved.select("image_id", "box_id", *[(F.col(a) + F.col(f"o{a}")).alias(a) for a in AXES], "v")
    last = placed.groupBy("image_id", *AXES).agg(F.max_by("v", "box_id").alias("_new"))
    return pixels.join(exploded(last), ["image_id", *AXES], "left").withColumn("v", F.coalesce("_new", "v")).drop("_new")


def atlas_layout(index: Column, n: int, h: int, w: int) -> dict[str, Column]:
    """oy, ox of the index-th of n boxes of h x w on a montage of ceil(sqrt(n)) columns."""
    columns = next(k for k in range(n + 1) if k * k >= n)
    return {"oy": (F.floor(index / columns) * h).cast("long"), "ox": (index % columns * w).cast("long")}
