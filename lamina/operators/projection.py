"""Projection between images and volumes, in real and in Fourier space.

Poses are small tables that meet the slices by image; the heavy results (voxels) are sums that are
combined before the shuffle. Every function groups by `volume_id`, so many reconstructions run at once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.elementwise import EPSILON
from ..model import AXES, FREQUENCIES, Shape, exploded, grid, offset, once
from .dense import arrays
from .geometry import LEAST_SHARE, SIZES, apply, at, gather, spectrum_gather, weights
from .tiles import TILE_PIXELS, in_batches, tile_entries, tile_shape

#: Voxels of a brick's edge, and images that a task adds to a brick, about.
BRICK = 32
PART_IMAGES = 1 << 12

#: Poses that meet an image or a brick at once, about, and points that a task works out at once.
BLOCK = 64
POINTS = 1 << 17

#: Bytes of volumes that are sent to every task at most; the driver gathers three times as much.
MOST_SENT = 1 << 20


def _low(c: np.ndarray, kernel: str) -> np.ndarray:
    """The index that a coordinate's taps are counted from."""
    if kernel == "nearest":
        return (np.floor(np.abs(c) + 0.5) * np.sign(c)).astype(np.int64)
    return np.floor(c).astype(np.int64)


def backward_project_3d(pixels: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, kernel: str = "linear", brick: int = BRICK, tile_pixels: int = TILE_PIXELS) -> DataFrame:
    """volume_id, z, y, x, v: each voxel sums its volume's images, interpolated where the voxel projects to; voxels that
    no pixel reaches have no row. poses: image_id, volume_id, matrix (2 x 4, voxel to image).

    The volume is cut into bricks of `brick` voxels an edge and the images into tiles. A task finds the tiles that each brick
    projects to from the poses alone, and each such tile moves once for the brick; a task holds one brick's sums while its tiles
    stream by. The images of a volume are dealt to parts of about PART_IMAGES, whose sums are added."""
    _, h, w = shape
    edges = tuple(min(n, brick) for n in volume)
    reach = SIZES[kernel] // 2 + (kernel == "nearest")
    halo = (0, reach, reach)
    tile = tile_shape(shape, halo, tile_pixels)
    region = (tile[1] + 2 * reach, tile[2] + 2 * reach)
    last = [(n - 1) // t for n, t in zip((h, w), tile[1:], strict=True)]
    grids = [np.arange(0, n, e) for n, e in zip(volume, edges, strict=True)]
    kinds = poses.select("image_id", "volume_id").schema
    image_kind, volume_kind = (kinds[c].dataType.simpleString() for c in ("image_id", "volume_id"))
    brick_key = ["volume_id", "bz", "by", "bx", "part"]

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pose the pairs of a brick and a tile that some voxel of it may read from."""
        for batch in batches:
            for k, m in enumerate(arrays(batch, "matrix")):
                low, high = (np.stack(np.broadcast_arrays(*(np.zeros(1) + m[4 * i + 3] for i in range(2)))).reshape(2, 1, 1, 1) + np.zeros([len(g) for g in grids]) for _ in range(2))
                for axis, (g, e, n) in enumerate(zip(grids, edges, volume, strict=True)):
                    ends = np.stack([g, np.minimum(g + e, n) - 1]).astype(float)
                    form = [len(g) if j == axis else 1 for j in range(3)]
                    for i in range(2):
                        both = m[4 * i + axis] * ends
                        low[i] += both.min(0).reshape(form)
                        high[i] += both.max(0).reshape(form)
                for b in np.ndindex(low.shape[1:]):
                    y0, x0, y1, x1 = *low[(slice(None), *b)], *high[(slice(None), *b)]
                    if not (y1 > -1 and y0 < h and x1 > -1 and x0 < w):
                        continue
                    # one pixel more on each side than the corners say, as they are rounded
                    (ya, yb), (xa, xb) = (tuple(min(max(math.floor(min(max(c, -2.0), n + 2.0)) + s, 0) // t, end) for c, s in ((c0, -1), (c1, 1))) for c0, c1, n, t, end in ((y0, y1, h, tile[1], last[0]), (x0, x1, w, tile[2], last[1])))
                    tiles = [(ty, tx) for ty in range(ya, yb + 1) for tx in range(xa, xb + 1)]
                    n = len(tiles)
                    same = [batch.column(c).take(pa.array([k] * n)) for c in ("image_id", "volume_id", "matrix", "part")]
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array([v] * n, pa.int64()) for v in b), pa.array([t[0] for t in tiles], pa.int64()), pa.array([t[1] for t in tiles], pa.int64())], ["image_id", "volume_id", "matrix", "part", "bz", "by", "bx", "ty", "tx"])

    def add(sums: np.ndarray, seen: np.ndarray, at: tuple[int, ...], m: np.ndarray, ty: int, tx: int, entries) -> None:
        starts = [k * e for k, e in zip(at, edges, strict=True)]
        z, y, x = np.ogrid[tuple(slice(s, min(s + e, n)) for s, e, n in zip(starts, edges, volume, strict=True))]
        cy, cx = (m[4 * i] * z + m[4 * i + 1] * y + m[4 * i + 2] * x + m[4 * i + 3] for i in range(2))
        low_y, low_x = _low(cy, kernel), _low(cx, kernel)
        own = (cy > -1) & (cy < h) & (cx > -1) & (cx < w)
        own &= (np.clip(low_y // tile[1], 0, last[0]) == ty) & (np.clip(low_x // tile[2], 0, last[1]) == tx)
        where = np.nonzero(own)
        if not len(where[0]):
            return
        held, there = np.zeros(region), np.zeros(region, bool)
        place = entries.values.field("place").to_numpy()
        held.ravel()[place], there.ravel()[place] = entries.values.field("v").to_numpy(zero_copy_only=False), True
        taps = []
        for c, low, n, t, j in ((cy, low_y, h, tile[1], ty), (cx, low_x, w, tile[2], tx)):
            c, low = c[where], low[where]
            shares, first = ([np.ones_like(c)], 0) if kernel == "nearest" else (weights(c - low, kernel, np), 1 - SIZES[kernel] // 2)
            taps.append([(low + first + k, low + first + k - (j * t - reach), (low + first + k >= 0) & (low + first + k < n), s) for k, s in enumerate(shares)])
        got, read = np.zeros(len(where[0])), np.zeros(len(where[0]), bool)
        for _, place_y, in_y, share_y in taps[0]:
            for _, place_x, in_x, share_x in taps[1]:
                share = share_y * share_x
                ok = in_y & in_x & (np.abs(share) >= LEAST_SHARE)
                py, px = np.where(ok, place_y, 0), np.where(ok, place_x, 0)
                ok &= there[py, px]
                got += np.where(ok, share * held[py, px], 0.0)
                read |= ok
        sums[where] += got
        seen[where] |= read

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bricks() -> Iterator[tuple[list, list[np.ndarray]]]:
            now, sums, seen = None, np.zeros(edges), np.zeros(edges, bool)

            def done() -> tuple[list, list[np.ndarray]]:
                found = np.nonzero(seen)
                return [now[0]], [*(k + j * e for k, j, e in zip(found, now[1:4], edges, strict=True)), sums[found]]

            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in brick_key), strict=True))
                for k, m in enumerate(arrays(batch, "matrix")):
                    if keys[k] != now:
                        if now is not None:
                            yield done()
                        now = keys[k]
                        sums[:], seen[:] = 0, False
                    add(sums[tuple(slice(0, n - j * e) for n, j, e in zip(volume, now[1:4], edges, strict=True))], seen[tuple(slice(0, n - j * e) for n, j, e in zip(volume, now[1:4], edges, strict=True))], now[1:4], m, batch.column("ty")[k].as_py(), batch.column("tx")[k].as_py(), batch.column("entries")[k])
            if now is not None:
                yield done()

        yield from in_batches(bricks(), arrow)

    counts = poses.groupBy(F.col("volume_id").alias("_volume")).agg(F.ceil(F.count("*") / PART_IMAGES).alias("_parts"))
    counted = exploded(poses.select("image_id", "volume_id", F.col("matrix").cast("array<double>").alias("matrix"))).join(counts, F.col("volume_id").eqNullSafe(F.col("_volume")))
    dealt = counted.select("image_id", "volume_id", "matrix", F.pmod(F.xxhash64("image_id", "matrix"), F.col("_parts")).alias("part"))
    pairs = dealt.mapInArrow(crossed, f"image_id {image_kind}, volume_id {volume_kind}, matrix array<double>, part long, bz long, by long, bx long, ty long, tx long")
    tiles = tile_entries(pixels, shape, halo, "zero", tile).drop("tz")
    met = exploded(pairs).join(tiles, ["image_id", "ty", "tx"]).select(*brick_key, "matrix", "ty", "tx", "entries")
    arrow = to_arrow_schema(poses.select("volume_id", *[F.lit(0).cast("long").alias(a) for a in AXES], F.lit(0.0).alias("v")).schema)
    sums = met.repartition(*brick_key).sortWithinPartitions(*brick_key).mapInArrow(summed, f"volume_id {volume_kind}, z long, y long, x long, v double")
    return sums.groupBy("volume_id", *AXES).agg(F.sum("v").alias("v"))


def backward_project_3d_joined(pixels: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, kernel: str = "linear") -> DataFrame:
    """backward_project_3d as a join of elements: a row for each voxel, image and tap."""
    _, h, w = shape
    held = {f"_m{k}": at("matrix", 0, k, 8) for k in range(8)}
    voxels = grid(once(poses.select("image_id", "volume_id", "matrix"), held).drop("matrix"), volume)
    cy, cx = (F.col(f"_m{4 * i}") * F.col("z") + F.col(f"_m{4 * i + 1}") * F.col("y") + F.col(f"_m{4 * i + 2}") * F.col("x") + F.col(f"_m{4 * i + 3}") for i in range(2))
    targets = voxels.withColumns({"cy": cy, "cx": cx}).drop(*held)
    inside = targets.filter((F.col("cy") > -1) & (F.col("cy") < h) & (F.col("cx") > -1) & (F.col("cx") < w))
    return gather(pixels, inside, ["volume_id", *AXES], shape, kernel, sparse=True)


def projection_window_size(volume: Shape) -> int:
    """An odd number of steps that crosses the volume along any axis."""
    size = math.ceil(math.sqrt(sum(n * n for n in volume)))
    return size + 1 - size % 2


def _along_axis(poses: DataFrame, shape: Shape, volume: Shape, window: int | None) -> DataFrame:
    """out_id, volume_id, y, x, cz, cy, cx: the points of the volume that each image pixel sums over.

    The window is centered where the axis through the pixel meets the plane through the volume's center that
    it reaches first. Points a voxel or more outside the volume are left out: each pixel's steps are cut to the stretch of
    its axis that crosses the volume before they are made, and all that depends on the pixel is computed once."""
    half = (window or projection_window_size(volume)) // 2
    center = [float(n // 2) for n in volume]
    m = [[at("matrix", i, j, 4) for j in range(4)] for i in range(3)]
    # everything is linear in y and x: a row (of 1, y, x) for the axis's start (_o), the middle step (_d), and where it
    # enters and leaves each pair of faces (_e, _f), all of the pose alone
    far = [F.coalesce(F.abs(F.try_divide(F.lit(c), m[i][0])), F.lit(float("inf"))) for i, c in enumerate(center)]
    nearest = F.when((far[0] <= far[1]) & (far[0] <= far[2]), 0).when(far[1] <= far[2], 1).otherwise(2)
    own = {f"_v{a}": m[i][0] for i, a in enumerate(AXES)} | {f"_o{a}{k}": m[i][j] for i, a in enumerate(AXES) for k, j in enumerate((3, 1, 2))}
    posed = once(poses.select(F.col("image_id").alias("out_id"), "volume_id", "matrix"), {"_n": nearest, **own}).drop("matrix")
    chosen = lambda name: F.when(F.col("_n") == 0, F.col(name.format("z"))).when(F.col("_n") == 1, F.col(name.format("y"))).otherwise(F.col(name.format("x")))
    middle = F.when(F.col("_n") == 0, center[0]).when(F.col("_n") == 1, center[1]).otherwise(center[2])
    along = {f"_d{k}": F.try_divide((middle if k == 0 else F.lit(0.0)) - chosen(f"_o{{}}{k}"), chosen("_v{}")) for k in range(3)}
    pixel = grid(once(posed, along).drop("_n"), shape).drop("z")
    row = lambda name: F.col(f"{name}0") + F.col(f"{name}1") * F.col("y") + F.col(f"{name}2") * F.col("x")
    first, last = F.lit(float(-half)), F.lit(float(half))
    for a, n in zip(AXES, volume, strict=True):
        ends = [F.try_divide(F.lit(e) - row(f"_o{a}"), F.col(f"_v{a}")) - row("_d") for e in (-1.0, float(n))]
        first = F.greatest(first, F.floor(F.least(*ends)).cast("double"))  # nulls, of an axis along the faces, don't count
        last = F.least(last, F.ceil(F.greatest(*ends)).cast("double"))
    reach = once(pixel, {"_first": first.cast("int"), "_last": last.cast("int")})
    steps = F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last"))
    stepped = reach.withColumn("_step", F.explode(steps)).drop("_first", "_last")
    here = row("_d") + F.col("_step")
    inside = stepped.select("out_id", "volume_id", "y", "x", *[(row(f"_o{a}") + F.col(f"_v{a}") * here).alias(f"c{a}") for a in AXES])
    for a, n in zip(AXES, volume, strict=True):
        inside = inside.filter((F.col(f"c{a}") > -1) & (F.col(f"c{a}") < n))
    return inside


def _cast_rays(matrix: np.ndarray, held: np.ndarray, shape: Shape, window: int, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """One image's sums along its axis through a volume (NaN where it has no voxel), and the pixels that read any."""
    d, h, w = held.shape
    sizes, center = np.array(held.shape), np.array([n // 2 for n in held.shape], float)
    y, x = (g.ravel().astype(float) for g in np.mgrid[0 : shape[1], 0 : shape[2]])
    v = matrix[:, 0]
    o = matrix[:, 1, None] * y + matrix[:, 2, None] * x + matrix[:, 3, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(v != 0, np.abs(center / v), np.inf)
        nearest = int(np.argmin(far))
        start = (center[nearest] - o[nearest]) / v[nearest]
    values, some = np.zeros(len(y)), np.zeros(len(y), bool)
    filled, known = np.nan_to_num(held).ravel(), ~np.isnan(held).ravel()
    for step in range(-(window // 2), window // 2 + 1):
        c = o + v[:, None] * (start + step)
        at = np.flatnonzero(((c > -1) & (c < sizes[:, None])).all(axis=0))
        if not len(at):
            continue
        axes = []
        for k in range(3):
            if sizes[k] == 1:
                axes.append([(np.zeros(len(at), int), np.ones(len(at)))])
                continue
            if kernel == "nearest":
                rounded = np.sign(c[k, at]) * np.floor(np.abs(c[k, at]) + 0.5)
                axes.append([(rounded.astype(int), np.ones(len(at)))])
                continue
            low = np.floor(c[k, at]).astype(int)
            first = 1 - SIZES[kernel] // 2
            axes.append([(low + first + j, share) for j, share in enumerate(weights(c[k, at] - low, kernel, np))])
        for iz, wz in axes[0]:
            for iy, wy in axes[1]:
                for ix, wx in axes[2]:
                    share = wz * wy * wx
                    good = (np.abs(share) >= LEAST_SHARE) & (iz >= 0) & (iz < d) & (iy >= 0) & (iy < h) & (ix >= 0) & (ix < w)
                    place = ((iz * h + iy) * w + ix)[good]
                    there = known[place]
                    np.add.at(values, at[good], share[good] * filled[place])
                    some[at[good][there]] = True
    return values, some


def _forward_sent(volumes: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, window: int, kernel: str) -> DataFrame:
    """Every task holds the volumes as arrays and sums whole images: no shuffle, one image's pixels at a time."""
    size = math.prod(volume)
    held: dict[int, np.ndarray] = {}
    place = offset(F.col("z"), F.col("y"), F.col("x"), volume[1], volume[2])
    for batch in volumes.select("image_id", place.cast("long").alias("place"), F.col("v").cast("double").alias("v")).toArrow().to_batches():
        ids, at, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("image_id", "place", "v"))
        for k in np.unique(ids).tolist():
            own = held.setdefault(k, np.full(size, np.nan))
            own[at[ids == k]] = v[ids == k]
    sent = volumes.sparkSession.sparkContext.broadcast(held)
    y, x = (g.ravel() for g in np.mgrid[0 : shape[1], 0 : shape[2]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrices = batch.column("matrix")
            for k, (image, of) in enumerate(zip(batch.column("image_id").to_pylist(), batch.column("volume_id").to_pylist(), strict=True)):
                if of not in sent.value:
                    continue
                matrix = matrices[k].values.to_numpy(zero_copy_only=False).reshape(3, 4)
                values, some = _cast_rays(matrix, sent.value[of].reshape(volume), shape, window, kernel)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(some.sum()), image)), pa.array(y[some]), pa.array(x[some]), pa.array(values[some])], ["image_id", "y", "x", "v"]
                )

    return poses.select("image_id", "volume_id", "matrix").mapInArrow(run, "image_id long, y long, x long, v double")


def forward_project_3d(volumes: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, window: int | None = None, kernel: str = "linear", most_sent: int = MOST_SENT, brick: int = BRICK) -> DataFrame:
    """image_id, y, x, v: each image pixel sums its volume along the projection axis; pixels that read no voxel have no row.
    volumes: pixels whose image_id is the volume's; poses: image_id, volume_id, matrix (3 x 4, image to volume).

    Volumes whose arrays take at most `most_sent` bytes together are sent to all tasks; more than that are cut into bricks,
    which meet the poses. Both give the same, and so does forward_project_3d_joined."""
    window = window or projection_window_size(volume)
    # no more ids are looked for than may be sent
    if most_sent and volumes.select("image_id").distinct().limit(most_sent // (math.prod(volume) * 8) + 1).count() * math.prod(volume) * 8 <= most_sent:
        return _forward_sent(volumes, poses, shape, volume, window, kernel)
    return _forward_bricks(volumes, poses, shape, volume, window, kernel, brick)


def forward_project_3d_joined(volumes: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, window: int | None = None, kernel: str = "linear") -> DataFrame:
    """forward_project_3d as a join of elements: a row for each pixel, step and tap."""
    points = _along_axis(poses, shape, volume, window).withColumnRenamed("volume_id", "image_id")
    out = gather(volumes, points, ["out_id", "y", "x"], volume, kernel, sparse=True)
    return out.withColumnRenamed("out_id", "image_id")


def _ray_points(poses: np.ndarray, y: np.ndarray, x: np.ndarray, volume: Shape, window: int, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The points of the volume that each pixel of each pose (3 x 4) sums over, as in _along_axis: the pose's number times the
    number of pixels plus the pixel's, and the coordinates. Steps that surely lie outside low .. high are left out."""
    sizes, center, half = np.array(volume, float)[:, None], np.array([n // 2 for n in volume], float), window // 2
    many = max(1, POINTS // len(y))
    for begin in range(0, len(poses), many):
        m = poses[begin : begin + many]
        v, o = m[:, :, 0], m[:, :, 1, None] * y + m[:, :, 2, None] * x + m[:, :, 3, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            nearest = np.where(v != 0, np.abs(center / v), np.inf).argmin(1)[:, None]
            start = (center[nearest] - np.take_along_axis(o, nearest[:, :, None], 1)[:, 0]) / np.take_along_axis(v, nearest, 1)
            ends = np.stack([(e[:, None] - o) / v[:, :, None] for e in (low, high)]) - start[:, None]
            along = (v == 0)[:, :, None]
            first = np.maximum(np.floor(np.where(along, -np.inf, ends.min(0))).max(1), -half)
            last = np.minimum(np.ceil(np.where(along, np.inf, ends.max(0))).min(1), half)
            count = np.where(last >= first, last - first + 1, 0)  # none where the axis has no direction
        each = max(1, POINTS // count.size)
        for k in range(0, int(count.max(initial=0)), each):
            steps, of, pixel = np.nonzero(np.arange(k, k + each)[:, None, None] < count)
            here = start[of, pixel] + (first[of, pixel] + (steps + k))
            c = o[of, :, pixel].T + v[of].T * here
            inside = ((c > -1) & (c < sizes)).all(0)
            yield ((begin + of) * len(y) + pixel)[inside], c[:, inside]


def _interpolated(held: list[np.ndarray], there: np.ndarray, starts: list[int], shape: tuple[int, ...], at: list[np.ndarray], low: list[np.ndarray], kernel: str, scale: np.ndarray, least: float = LEAST_SHARE) -> tuple[list[np.ndarray], np.ndarray]:
    """Values at coordinates (an array an axis) times scale, from the parts of arrays of `shape` that begin at `starts`, and
    which of them read an element. low is the index that each coordinate's taps are counted from."""
    axes = []
    for c, base, n, start in zip(at, low, shape, starts, strict=True):
        if n == 1:
            axes.append([(np.full(c.shape, -start), np.ones(c.shape, bool), 1.0)])
            continue
        shares, first = ([np.ones_like(c)], 0) if kernel == "nearest" else (weights(c - base, kernel, np), 1 - SIZES[kernel] // 2)
        index = [base + (first + k) for k in range(len(shares))]
        axes.append([(i - start, (i >= 0) & (i < n), s) for i, s in zip(index, shares, strict=True)])
    got, read = [np.zeros(len(scale)) for _ in held], np.zeros(len(scale), bool)
    for taps in itertools.product(*axes):
        share, ok, place = scale, True, 0
        for (i, inside, s), size in zip(taps, there.shape, strict=True):
            share, ok, place = share * s, ok & inside, place * size + i
        ok = ok & (np.abs(share) >= least)
        place = np.where(ok, place, 0)
        ok &= there.ravel()[place]
        for sums, values in zip(got, held, strict=True):
            sums += np.where(ok, share * values.ravel()[place], 0.0)
        read |= ok
    return got, read


def _region(batch: pa.RecordBatch, k: int, region: tuple[int, ...], values: tuple[str, ...] = ("v",)) -> tuple[list[np.ndarray], np.ndarray]:
    """A tile's values, those of equal places added up, and which places it has; a row without a tile has none."""
    size = math.prod(region)
    there = np.zeros(size, bool)
    if not batch.column("places")[k].is_valid:
        return [np.zeros(region) for _ in values], there.reshape(region)
    place = batch.column("places")[k].values.to_numpy()
    held = [np.bincount(place, batch.column(c)[k].values.fill_null(0.0).to_numpy(zero_copy_only=False), size) for c in values]
    there[place] = True
    return [v.reshape(region) for v in held], there.reshape(region)


def _flat_tiles(pixels: DataFrame, shape: Shape, halo: Shape, tile: Shape, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """tile_entries with places and values as arrays of their own, which are half as long."""
    held = tile_entries(pixels, shape, halo, "zero", tile, values)
    return held.select("image_id", *[F.col(f"t{a}").cast("long").alias(f"t{a}") for a in AXES], F.col("entries.place").cast("array<int>").alias("places"), *[F.col(f"entries.{c}").alias(c) for c in values])


def _doubles(poses: DataFrame, *more: str) -> DataFrame:
    """image_id, volume_id and the matrices, those of poses that have them."""
    held = ["matrix", *more]
    own = poses.select("image_id", "volume_id", *[F.col(c).cast("array<double>").alias(c) for c in held])
    return own.dropna(subset=["volume_id", *held])


def _dealt(poses: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """The number of blocks that each volume's poses are dealt to, volume_id and blocks, and volume_id, block, outs (image_id, matrix
    and more)."""
    own = _doubles(poses, *more)
    counts = own.groupBy("volume_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    each = own.join(counts.hint("shuffle_hash"), "volume_id")
    dealt = each.groupBy("volume_id", F.pmod(F.xxhash64("image_id", "matrix"), F.col("blocks")).alias("block"))
    return counts, dealt.agg(F.collect_list(F.struct("image_id", "matrix", *more)).alias("outs"))


def _outs(batch: pa.RecordBatch, k: int, size: int) -> tuple[list, np.ndarray]:
    """The ids and matrices of a row's block of poses."""
    outs = batch.column("outs")[k].values
    return outs.field("image_id").to_pylist(), _stacked(outs.field("matrix"), (3, size))


def _stacked(matrices: pa.Array, form: tuple[int, int]) -> np.ndarray:
    return np.array([m.values.to_numpy(zero_copy_only=False) for m in matrices], float).reshape(len(matrices), *form)


def _forward_bricks(volumes: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, window: int, kernel: str, brick: int) -> DataFrame:
    """The volumes cut into bricks of `brick` voxels an edge, each of which moves once for each block of poses. A task sums the
    stretches of the rays that cross a brick, so a pixel moves once for each brick that its ray crosses."""
    d, h, w = volume
    reach = tuple((SIZES[kernel] // 2 + (kernel == "nearest")) * (n > 1) for n in volume)
    edges = tuple(max(min(n, brick), r) for n, r in zip(volume, reach, strict=True))
    region = tuple(e + 2 * r for e, r in zip(edges, reach, strict=True))
    last = [(n - 1) // e for n, e in zip(volume, edges, strict=True)]
    bricks = [f"t{a}" for a in AXES]

    def reached(m: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pixels whose axis may cross low .. high, one more on each side."""
        ends = [(0, n - 1) for n in shape[1:]]
        if abs(np.linalg.det(m[:, :3])) > 1e-6 * np.prod(np.linalg.norm(m[:, :3], axis=0)):
            corners = np.array(list(itertools.product(*zip(low, high, strict=True)))).T - m[:, 3:]
            at = np.linalg.solve(m[:, :3], corners)[1:]
            ends = [(max(a, math.floor(c.min()) - 1), min(b, math.ceil(c.max()) + 1)) for (a, b), c in zip(ends, at, strict=True)]
        y, x = (g.ravel() for g in np.mgrid[tuple(slice(a, b + 1) for a, b in ends)])
        return y, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def images() -> Iterator[tuple[list, list[np.ndarray]]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    at = [batch.column(c)[k].as_py() for c in bricks]
                    held, there = _region(batch, k, region)
                    starts = [b * e - r for b, e, r in zip(at, edges, reach, strict=True)]
                    # the taps of a brick's points are counted from its own voxels, of the outer ones also from beyond
                    low = np.array([-1.0 if b == 0 else b * e - 1.0 for b, e in zip(at, edges, strict=True)])
                    high = np.array([float(n) if b == z else (b + 1) * e + 1.0 for b, e, z, n in zip(at, edges, last, volume, strict=True)])
                    for image, m in zip(*_outs(batch, k, 4), strict=True):
                        y, x = reached(m, low, high)
                        for s in range(0, len(y), POINTS):
                            part = slice(s, s + POINTS)
                            sums, seen = np.zeros(len(y[part])), np.zeros(len(y[part]), bool)
                            for slot, c in _ray_points(m[None], y[part], x[part], volume, window, low, high):
                                base = [_low(a, kernel) for a in c]
                                own = np.logical_and.reduce([np.clip(i // e, 0, z) == b for i, e, z, b in zip(base, edges, last, at, strict=True)])
                                slot, c, base = slot[own], [a[own] for a in c], [i[own] for i in base]
                                (got,), read = _interpolated(held, there, starts, volume, c, base, kernel, np.ones(len(slot)))
                                sums += np.bincount(slot, got, len(sums))
                                seen[slot[read]] = True
                            yield [image], [y[part][seen], x[part][seen], sums[seen]]

        yield from in_batches(images(), arrow)

    counts, outs = _dealt(poses)
    every = lambda df: exploded(grid(df, tuple(z + 1 for z in last)).select(*df.columns, *[F.col(a).alias(f"t{a}") for a in AXES]))
    blocks = every(counts.select("volume_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")))
    tiles = _flat_tiles(volumes, volume, reach, edges).withColumnRenamed("image_id", "volume_id")
    met = blocks.join(tiles, ["volume_id", *bricks])
    key = ["volume_id", "block", *bricks]
    rows = exploded(met).join(every(outs), key).select(*bricks, "places", "v", "outs")
    made = poses.select("image_id", *[F.lit(0).cast("long").alias(a) for a in AXES[1:]], F.lit(0.0).alias("v")).schema
    arrow = to_arrow_schema(made)
    return rows.mapInArrow(run, made).groupBy("image_id", "y", "x").agg(F.sum("v").alias("v"))


def backward_and_forward_project_3d(pixels: DataFrame, inputs: DataFrame, outputs: DataFrame, shape: Shape, volume: Shape, window: int | None = None, kernel: str = "linear", tile_pixels: int = TILE_PIXELS) -> DataFrame:
    """image_id, y, x, v: images projected into a volume and out again, without the volume: the points that an output pixel
    sums over are read from every input image of the volume. Beyond the volume's outer voxels a point counts less,
    linearly to 0 one voxel out. inputs: matrix 2 x 4 (volume to image); outputs: matrix 3 x 4 (image to volume).

    Images are cut into tiles and a volume's outputs are dealt to blocks of about BLOCK, its inputs to parts of about PART_IMAGES. An
    input tile moves once for each block and output tile whose points may read it; a task holds the sums of one block and output
    tile and works out the points from the poses, so nothing is made for a point but in the task."""
    window = window or projection_window_size(volume)
    _, h, w = shape
    reach = (0, *((SIZES[kernel] // 2 + (kernel == "nearest")) * (n > 1) for n in (h, w)))
    tile = tile_shape(shape, reach, tile_pixels)
    region = (tile[1] + 2 * reach[1], tile[2] + 2 * reach[2])
    last = [(n - 1) // t for n, t in zip((h, w), tile[1:], strict=True)]
    low, high = np.full(3, -1.0), np.array(volume, float)
    key = ["volume_id", "block", "part", "oy", "ox"]

    def pixels_of(oy: int, ox: int) -> tuple[np.ndarray, np.ndarray]:
        y, x = (g.ravel() for g in np.mgrid[oy * tile[1] : min(h, (oy + 1) * tile[1]), ox * tile[2] : min(w, (ox + 1) * tile[2])])
        return y, x

    def points(outs: np.ndarray, y: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for slot, c in _ray_points(outs, y, x, volume, window, low, high):
            edge = np.ones(len(slot))
            for a, n in zip(c, volume, strict=True):
                edge *= np.where(a < 0, 1 + a, np.where(a > n - 1, n - a, 1.0))
            yield slot, c, edge

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The input tiles that the points of a block and output tile may read: the corners of the stretch of each axis bound them, and
        so do the volume's."""
        box = np.array(list(itertools.product(*zip(low, high, strict=True))))
        for batch in batches:
            inputs_held = arrays(batch, "matrix")
            for k in range(batch.num_rows):
                m = inputs_held[k].reshape(2, 4)
                y, x = pixels_of(batch.column("oy")[k].as_py(), batch.column("ox")[k].as_py())
                _, outs = _outs(batch, k, 4)
                corners = np.array([(a, b) for a in (y[0], y[-1]) for b in (x[0], x[-1])], float).T
                v, o = outs[:, :, 0], outs[:, :, 1, None] * corners[0] + outs[:, :, 2, None] * corners[1] + outs[:, :, 3, None]
                middle = np.array([n // 2 for n in volume], float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    nearest = np.where(v != 0, np.abs(middle / v), np.inf).argmin(1)[:, None]
                    start = (middle[nearest] - np.take_along_axis(o, nearest[:, :, None], 1)[:, 0]) / np.take_along_axis(v, nearest, 1)
                    c = np.concatenate([o + v[:, :, None] * (start + s)[:, None] for s in (-(window // 2), window // 2)], 2)
                c = c[np.isfinite(c).all((1, 2))]
                if not len(c):
                    continue
                reads = np.einsum("ij,kjp->ikp", m[:, :3], c) + m[:, 3, None, None]
                most = box @ m[:, :3].T + m[:, 3]
                ends = [(max(r.min(1).min(), b.min()), min(r.max(1).max(), b.max())) for r, b in zip(reads, most.T, strict=True)]
                if any(not (b > -1 - 1e-6 and a < n + 1e-6) for (a, b), n in zip(ends, (h, w), strict=True)):
                    continue
                (ya, yb), (xa, xb) = (tuple(min(max(math.floor(min(max(c, -2.0), n + 2.0)) + s, 0) // t, z) for c, s in zip(e, (-1, 1), strict=True)) for e, n, t, z in zip(ends, (h, w), tile[1:], last, strict=True))
                found = [(ty, tx) for ty in range(ya, yb + 1) for tx in range(xa, xb + 1)]
                same = [batch.column(c).take(pa.array([k] * len(found), pa.int64())) for c in ("image_id", "matrix", *key)]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array([t[i] for t in found], pa.int64()) for i in range(2))], ["image_id", "matrix", *key, "ty", "tx"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def images() -> Iterator[tuple[list, list[np.ndarray]]]:
            now = held_points = None
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
                matrices = arrays(batch, "matrix")
                for k, this in enumerate(keys):
                    if this != now:
                        if now is not None:
                            yield from done(ids, sums, seen, y, x)
                        now = this
                        y, x = pixels_of(*this[3:])
                        ids, outs = _outs(batch, k, 4)
                        sums, seen = np.zeros(len(ids) * len(y)), np.zeros(len(ids) * len(y), bool)
                        held_points = list(points(outs, y, x)) if len(sums) * window <= POINTS else None
                    m = matrices[k].reshape(2, 4)
                    ty, tx = batch.column("ty")[k].as_py(), batch.column("tx")[k].as_py()
                    held, there = _region(batch, k, region)
                    for slot, c, edge in held_points if held_points is not None else points(outs, y, x):
                        at = m[:, :3] @ c + m[:, 3, None]
                        base = [_low(a, kernel) for a in at]
                        own = (at > -1).all(0) & (at[0] < h) & (at[1] < w)
                        own &= (np.clip(base[0] // tile[1], 0, last[0]) == ty) & (np.clip(base[1] // tile[2], 0, last[1]) == tx)
                        where = slot[own]
                        (got,), read = _interpolated(held, there, [ty * tile[1] - reach[1], tx * tile[2] - reach[2]], (h, w), [a[own] for a in at], [i[own] for i in base], kernel, edge[own])
                        sums += np.bincount(where, got, len(sums))
                        seen[where[read]] = True
            if now is not None:
                yield from done(ids, sums, seen, y, x)

        def done(ids: list, sums: np.ndarray, seen: np.ndarray, y: np.ndarray, x: np.ndarray) -> Iterator[tuple[list, list[np.ndarray]]]:
            for image, v, some in zip(ids, sums.reshape(len(ids), -1), seen.reshape(len(ids), -1), strict=True):
                yield [image], [y[some], x[some], v[some]]

        yield from in_batches(images(), arrow)

    def every(df: DataFrame) -> DataFrame:
        return exploded(grid(df, (1, last[0] + 1, last[1] + 1)).drop("z").withColumnsRenamed({"y": "oy", "x": "ox"}))

    zero = F.lit(0).cast("long")
    counts, outs = _dealt(outputs)
    sent = _doubles(inputs)
    parts = sent.groupBy("volume_id").agg(F.ceil(F.count("*") / PART_IMAGES).alias("parts")).join(counts.hint("shuffle_hash"), "volume_id")
    dealt = sent.join(parts.hint("shuffle_hash"), "volume_id").withColumn("part", F.pmod(F.xxhash64("image_id", "matrix"), F.col("parts")))
    pairs = every(dealt.withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1))).drop("blocks", "parts"))
    posed = outs.join(parts.hint("shuffle_hash"), "volume_id").withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1))).drop("blocks", "parts")
    blocks = every(posed)
    if any(last):
        kinds = pairs.schema
        made = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("image_id", "matrix", *key))
        pairs = exploded(pairs.join(blocks, key).mapInArrow(crossed, f"{made}, ty long, tx long"))
    else:
        pairs = pairs.withColumns({"ty": zero, "tx": zero})
    tiles = _flat_tiles(pixels, shape, reach, tile).drop("tz")
    met = exploded(pairs).join(tiles, ["image_id", "ty", "tx"])
    rows = exploded(met).join(blocks, key).select(*key, "matrix", "ty", "tx", "places", "v", "outs")
    schema = outputs.select("image_id", *[F.lit(0).cast("long").alias(a) for a in AXES[1:]], F.lit(0.0).alias("v")).schema
    arrow = to_arrow_schema(schema)
    out = rows.sortWithinPartitions(*key).mapInArrow(summed, schema)
    return out.groupBy("image_id", "y", "x").agg(F.sum("v").alias("v"))


def backward_and_forward_project_3d_joined(pixels: DataFrame, inputs: DataFrame, outputs: DataFrame, shape: Shape, volume: Shape, window: int | None = None, kernel: str = "linear") -> DataFrame:
    """backward_and_forward_project_3d as a join of elements: a row for each point, input image and tap."""
    points = _along_axis(outputs, shape, volume, window)
    weight = F.lit(1.0)
    for a, n in zip(AXES, volume, strict=True):
        c = F.col(f"c{a}")
        weight = weight * F.when(c < 0, 1 + c).when(c > n - 1, n - c).otherwise(1.0)
    near = exploded(points.withColumn("edge", weight)).join(inputs.select("image_id", "volume_id", "matrix"), "volume_id")
    iy, ix = apply("matrix", 2, [F.col("cz"), F.col("cy"), F.col("cx"), F.lit(1.0)])
    targets = near.select("image_id", "out_id", "y", "x", "edge", iy.alias("cy"), ix.alias("cx"))
    inside = targets.filter((F.col("cy") > -1) & (F.col("cy") < shape[1]) & (F.col("cx") > -1) & (F.col("cx") < shape[2]))
    out = gather(pixels, inside, ["out_id", "y", "x"], shape, kernel, sparse=True, weight="edge")
    return out.withColumnRenamed("out_id", "image_id")


Radius = float | tuple[float, float]


def _sphere(fy: Column, fx: Column, ews_radius: Radius) -> Column:
    """Height of the Ewald sphere over a slice's frequency, for small angles: f^2 / (2 radius). The radius (pixel size by wave
    length) may differ for y and x; 0 is a flat slice."""
    ry, rx = ews_radius if isinstance(ews_radius, tuple) else (ews_radius, ews_radius)
    return (fy * fy / (2 * ry) if ry else F.lit(0.0)) + (fx * fx / (2 * rx) if rx else F.lit(0.0))


def _scaled(points: DataFrame, fy: Column, fx: Column) -> list[Column]:
    """Frequencies of a slice through the 2 x 2 matrix of a column `scaling`, if there is one."""
    return apply("scaling", 2, [fy, fx]) if "scaling" in points.columns else [fy, fx]


def _posed(poses: DataFrame, *more: Column) -> DataFrame:
    return poses.select("image_id", "volume_id", "matrix", *[c for c in ("scaling",) if c in poses.columns], *more)


def _slice_to_grid(points: DataFrame, fy: Column, fx: Column, ews_radius: Radius) -> DataFrame:
    """points with gz, gy, gx: a slice's frequencies scaled, bent and turned (`matrix`, 3 x 3) to where they lie in the volume.
    The magnification comes first, so the sphere stays one whatever it is."""
    sy, sx = _scaled(points, fy, fx)
    scaled = once(points, {"_sy": sy, "_sx": sx})
    flat = F.col("_sy"), F.col("_sx")
    turned = apply("matrix", 3, [_sphere(*flat, ews_radius), *flat])
    return once(scaled, {f"g{a}": c for a, c in zip(AXES, turned, strict=True)}).drop("_sy", "_sx", "matrix", "scaling")


def _within(points: DataFrame, cutoff: float) -> DataFrame:
    return points.filter(F.col("gz") * F.col("gz") + F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx") <= cutoff * cutoff)


def rasterize_central_slices_3d(spectrum: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, cutoff: float = 0.5, ews_radius: Radius = 0.0, target: Shape | None = None) -> DataFrame:
    """volume_id, kz, ky, kx, re, im, weight: slices spread over the 8 nearest voxels of their volume's half spectrum. poses:
    image_id, volume_id, matrix (3 x 3, forward rotation), where magnified `scaling` (2 x 2, the inverse magnification), and, if
    slices count unequally, `weight`, which scales what a slice adds to values and weights alike. A column `weight` of the
    spectrum is what its elements add to the weights (1 without it). target is the shape that frequencies of the grid refer to,
    where it isn't the grid's own: a larger one spreads the slices out, for instance to keep only low frequencies.

    Eight rows for each slice element, summed before the shuffle, so the crowded low frequencies cost one row a task.
    The plane kx = 0 also gets the conjugates at its mirrored places, which keeps it Hermitian."""
    own = F.col("weight").cast("double") if "weight" in poses.columns else F.lit(1.0)
    adds = F.col("weight").cast("double") if "weight" in spectrum.columns else F.lit(1.0)
    points = spectrum.select("image_id", "ky", "kx", "re", "im", adds.alias("_adds")).join(_posed(poses, own.alias("_own")), "image_id")
    kept = _within(_slice_to_grid(points, F.col("ky") / float(shape[1]), F.col("kx") / float(shape[2]), ews_radius), cutoff)
    sign = F.when(F.col("gx") < 0, -1.0).otherwise(1.0)
    placed = kept.select(
        "volume_id", (F.col("re") * F.col("_own")).alias("re"), (F.col("im") * sign * F.col("_own")).alias("im"), (F.col("_adds") * F.col("_own")).alias("_adds"),
        *[(F.col(f"g{a}") * sign * float(n)).alias(f"f{a}") for a, n in zip(AXES, target or volume, strict=True)],
    )
    low = {a: F.floor(f"f{a}").cast("long") for a in AXES}
    part = {a: F.col(f"f{a}") - F.col(f"b{a}") for a in AXES}
    based = placed.withColumns({f"b{a}": low[a] for a in AXES})
    each = []
    for corner in range(8):
        step = dict(zip(AXES, ((corner >> 2) & 1, (corner >> 1) & 1, corner & 1), strict=True))
        share = F.lit(1.0)
        for a in AXES:
            share = share * (part[a] if step[a] else 1 - part[a])
        k = {a: F.col(f"b{a}") + step[a] for a in AXES}
        each.append(F.struct(k["z"].alias("kz"), k["y"].alias("ky"), k["x"].alias("kx"), share.alias("share"), F.lit(1.0).alias("s")))
        if not step["x"]:  # the mirror, only where the base lies on the plane kx = 0
            on = F.when(F.col("bx") == 0, share)
            each.append(F.struct((-k["z"]).alias("kz"), (-k["y"]).alias("ky"), k["x"].alias("kx"), on.alias("share"), F.lit(-1.0).alias("s")))
    spread = exploded(based.select("volume_id", "re", "im", "_adds", F.explode(F.array(*each)).alias("t")).filter(F.col("t.share") >= LEAST_SHARE))
    d, h, w = volume
    inside = spread.filter(F.col("t.kz").between(-(d // 2), (d - 1) // 2) & F.col("t.ky").between(-(h // 2), (h - 1) // 2) & F.col("t.kx").between(0, w // 2))
    return inside.groupBy("volume_id", *[F.col(f"t.{k}").alias(k) for k in FREQUENCIES]).agg(
        F.sum(F.col("re") * F.col("t.share")).alias("re"), F.sum(F.col("im") * F.col("t.s") * F.col("t.share")).alias("im"), F.sum(F.col("_adds") * F.col("t.share")).alias("weight")
    )


def weight_corrected(spectrum: DataFrame) -> DataFrame:
    """Rasterized values divided by their weights, 0 where there is none."""
    divide = lambda c: F.when(F.abs("weight") < EPSILON, 0.0).otherwise(F.try_divide(F.col(c), F.col("weight")))
    return spectrum.withColumns({"re": divide("re"), "im": divide("im")})


def windowed_sinc(f: Column, sinc: float, blackman: float) -> Column:
    x = math.pi * f
    s = x / sinc
    b = x / blackman
    return F.when(s == 0, 1.0).otherwise(F.sin(s) / F.when(s != 0, s)) * (0.42 + 0.5 * F.cos(b) + 0.08 * F.cos(2 * b))


def _least(window: tuple[float, float], n: int) -> tuple[float, float]:
    """A windowed sinc (sinc, blackman) is at least one sample of n wide."""
    return max(window[0], 1 / n), max(window[1], 1 / n)


def _summed(values: DataFrame, near: DataFrame, keys: list[str], weighted: bool) -> DataFrame:
    """keys, re, im, weight for every key of near: 0 where nothing was read; the weight is what the windows sum to unless the
    spectrum has weights of its own."""
    windows = exploded(near.groupBy(*keys).agg(F.sum("window").alias("_windows")))
    weight = F.coalesce("weight", F.lit(0.0)) if weighted else F.col("_windows")
    found = windows.join(values, keys, "left")
    return found.select(*keys, F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"), weight.alias("weight"))


def slices_at(points: DataFrame, spectrum: DataFrame, poses: DataFrame, keys: list[str], shape: Shape, sinc: float, blackman: float, ews_radius: Radius = 0.0) -> DataFrame:
    """keys, re, im, weight: at 3-d frequencies (gz, gy, gx; cycles a pixel) the sum of a volume's slices that pass
    within `blackman` of the point, each read by interpolation and weighted by a windowed sinc of its distance and by the
    point's own column `window`. points: volume_id, keys, gz, gy, gx, window; poses: image_id, volume_id, matrix (3 x 3, inverse
    rotation) and, where magnified, scaling (2 x 2, the magnification). A column `weight` of the spectrum is read and summed
    like the values."""
    near = exploded(points).join(_posed(poses), "volume_id")
    turned = apply("matrix", 3, [F.col("gz"), F.col("gy"), F.col("gx")])
    moved = once(near, {f"h{a}": c for a, c in zip(AXES, turned, strict=True)})
    high = F.col("hz") - _sphere(F.col("hy"), F.col("hx"), ews_radius)
    close = once(moved, {"_off": high}).filter(F.abs("_off") <= blackman)
    fy, fx = _scaled(close, F.col("hy"), F.col("hx"))
    targets = close.select(
        "image_id", *keys, (windowed_sinc(F.col("_off"), sinc, blackman) * F.col("window")).alias("window"),
        F.lit(0.0).alias("fz"), (fy * float(shape[1])).alias("fy"), (fx * float(shape[2])).alias("fx"),
    )
    weighted = "weight" in spectrum.columns
    return _summed(spectrum_gather(spectrum, targets, keys, shape, "window", weighted), targets, keys, weighted)


def _slice_sums(spectrum: DataFrame, inserted: DataFrame, blocks: DataFrame | None, units: tuple[int, ...], points, named, keys: DataFrame, shape: Shape, sinc: float, blackman: float, ews_radius: Radius, tile_pixels: int) -> DataFrame:
    """What slices_at gives at points that tasks work out: of each volume (blocks: for each block of poses, `outs`) in `units` parts
    along three axes. points(outs, unit) yields the points' numbers, frequencies and windows, a piece at a time; named(volume, outs,
    unit, seen, sums) the rows of those seen.

    Half spectra are cut into tiles, and a volume's slices are dealt to parts of about PART_IMAGES. A tile moves once for each
    unit whose points may read it; a task holds one unit's sums."""
    weighted = "weight" in spectrum.columns
    values = ("re", "im", "weight") if weighted else ("re", "im")
    scaled = ("scaling",) if "scaling" in inserted.columns else ()
    form = (1, shape[1], shape[2] // 2 + 1)
    halo = tuple(int(n > 1) for n in form)
    tile = tile_shape(form, halo, tile_pixels)
    region = tuple(t + 2 * h for t, h in zip(tile, halo, strict=True))
    last = [(n - 1) // t for n, t in zip(form, tile, strict=True)][1:]
    key = ["volume_id", "block", "part", "bz", "by", "bx"]
    in_blocks = blocks is not None
    radii = ews_radius if isinstance(ews_radius, tuple) else (ews_radius, ews_radius)

    def close(m: np.ndarray, scaling: np.ndarray | None, slot: np.ndarray, g: np.ndarray, window: np.ndarray):
        """The points that a slice passes: number, window, side of kx = 0, place in the spectrum, base of the taps, tile."""
        m = m.reshape(3, 3)
        hz, hy, hx = (m[i, 0] * g[0] + m[i, 1] * g[1] + m[i, 2] * g[2] for i in range(3))
        off = hz - sum(h * h / (2 * r) if r else 0.0 for h, r in zip((hy, hx), radii, strict=True))
        near = np.abs(off) <= blackman
        hy, hx = hy[near], hx[near]
        if scaling is not None:
            hy, hx = (scaling[2 * i] * hy + scaling[2 * i + 1] * hx for i in range(2))
        fy, fx = hy * shape[1], hx * shape[2]
        fx = np.where(np.abs(fx) < LEAST_SHARE, 0.0, fx)
        side = np.where(fx < 0, -1.0, 1.0)
        at = [fy * side + shape[1] // 2, fx * side]
        base = [np.floor(c).astype(np.int64) for c in at]
        of = [np.clip(b // t, 0, z) for b, t, z in zip(base, tile[1:], last, strict=True)]
        return slot[near], _sinc_windows(off[near], sinc, blackman) * window[near], side, at, base, of[0] * (last[1] + 1) + of[1]

    def posed(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple, np.ndarray, np.ndarray | None]]:
        matrices = arrays(batch, "matrix")
        scalings = arrays(batch, "scaling") if scaled else [None] * batch.num_rows
        yield from zip(range(batch.num_rows), zip(*(batch.column(c).to_pylist() for c in key), strict=True), matrices, scalings, strict=True)

    def unit_of(batch: pa.RecordBatch, k: int, this: tuple):
        """The unit's poses, number of points and points: held where they are few, else worked out each time."""
        outs = batch.column("outs")[k].values if in_blocks else None
        first = points(outs, this[3:])
        size = next(first)
        held = list(itertools.islice(first, 2))
        again = (lambda: iter(held)) if len(held) < 2 else lambda: itertools.islice(points(outs, this[3:]), 1, None)
        return outs, size, again

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = again = None
        for batch in batches:
            for k, this, m, scaling in posed(batch):
                if this != now:
                    now, (_, _, again) = this, unit_of(batch, k, this)
                found = np.unique(np.concatenate([np.zeros(0, np.int64), *(close(m, scaling, *piece)[-1] for piece in again())]))
                same = [batch.column(c).take(pa.array([k] * len(found), pa.int64())) for c in ("image_id", "matrix", *scaled, *key)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(found // (last[1] + 1)), pa.array(found % (last[1] + 1))], ["image_id", "matrix", *scaled, *key, "ty", "tx"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[list, list[np.ndarray]]]:
            now = outs = again = sums = seen = None
            for batch in batches:
                for k, this, m, scaling in posed(batch):
                    if this != now:
                        if now is not None:
                            yield from named(now[0], outs, now[3:], seen, sums)
                        now, (outs, size, again) = this, unit_of(batch, k, this)
                        sums, seen = [np.zeros(size) for _ in range(3)], np.zeros(size, bool)
                    ty, tx = batch.column("ty")[k].as_py(), batch.column("tx")[k].as_py()
                    held, there = _region(batch, k, region, values)
                    held, there = [v[0] for v in held], there[0]
                    starts = [t * e - h for t, e, h in zip((ty, tx), tile[1:], halo[1:], strict=True)]
                    for piece in again():
                        slot, share, side, at, base, of = close(m, scaling, *piece)
                        own = of == ty * (last[1] + 1) + tx
                        slot, share = slot[own], share[own]
                        got, _ = _interpolated(held, there, starts, form[1:], [c[own] for c in at], [b[own] for b in base], "linear", share, 0.0)
                        got[1] *= side[own]
                        for total, part in zip(sums, got if weighted else [*got, share], strict=True):
                            total += np.bincount(slot, part, len(total))
                        seen[slot] = True
            if now is not None:
                yield from named(now[0], outs, now[3:], seen, sums)

        yield from in_batches(rows(), arrow)

    def every(df: DataFrame) -> DataFrame:
        return exploded(grid(df, units).withColumnsRenamed({a: f"b{a}" for a in AXES}))

    zero = F.lit(0).cast("long")
    sent = _doubles(inserted, *scaled)
    parts = sent.groupBy("volume_id").agg(F.ceil(F.count("*") / PART_IMAGES).alias("parts"))
    if blocks is None:
        parts = parts.withColumn("blocks", F.lit(1).cast("long"))
    else:
        parts = parts.join(blocks.groupBy("volume_id").agg((F.max("block") + 1).alias("blocks")).hint("shuffle_hash"), "volume_id")
    dealt = sent.join(parts.hint("shuffle_hash"), "volume_id").withColumn("part", F.pmod(F.xxhash64("image_id", "matrix"), F.col("parts")))
    pairs = every(dealt.withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1))).drop("blocks", "parts"))
    if blocks is not None:
        spread = blocks.join(parts.drop("blocks").hint("shuffle_hash"), "volume_id")
        outs = every(spread.withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1))).drop("parts"))
    if any(last):
        kinds = pairs.schema
        made = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("image_id", "matrix", *scaled, *key))
        from_ = pairs.repartition(*key).sortWithinPartitions(*key) if blocks is None else pairs.join(outs, key)
        pairs = exploded(from_.mapInArrow(crossed, f"{made}, ty long, tx long"))
    else:
        pairs = pairs.withColumns({"ty": zero, "tx": zero})
    placed = spectrum.select("image_id", zero.alias("z"), (F.col("ky") + shape[1] // 2).alias("y"), F.col("kx").alias("x"), *values)
    inside = placed.filter(F.col("y").between(0, form[1] - 1) & F.col("x").between(0, form[2] - 1))
    met = exploded(pairs).join(_flat_tiles(inside, form, halo, tile, values).drop("tz"), ["image_id", "ty", "tx"], "left")
    ready = met.repartition(*key) if blocks is None else exploded(met).join(outs, key)
    schema = keys.select("*", *[F.lit(0.0).alias(c) for c in ("re", "im", "weight")]).schema
    arrow = to_arrow_schema(schema)
    out = ready.sortWithinPartitions(*key).mapInArrow(summed, schema)
    return out.groupBy(*keys.columns).agg(*[F.sum(c).alias(c) for c in ("re", "im", "weight")])


def _sinc_windows(f: np.ndarray, sinc: float, blackman: float) -> np.ndarray:
    """windowed_sinc of arrays."""
    x = math.pi * f
    s, b = x / sinc, x / blackman
    return np.where(s == 0, 1.0, np.sin(s) / np.where(s != 0, s, 1.0)) * (0.42 + 0.5 * np.cos(b) + 0.08 * np.cos(2 * b))


def _volume_points(poses: DataFrame, volume: Shape, cutoff: float, target: Shape) -> DataFrame:
    d, h, w = volume
    points = poses.select("volume_id").distinct().withColumn("window", F.lit(1.0))
    for k, lo, hi in (("kz", -(d // 2), (d - 1) // 2), ("ky", -(h // 2), (h - 1) // 2), ("kx", 0, w // 2)):
        points = points.withColumn(k, F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))))
    g = {f"g{a}": F.col(k) / float(n) for a, k, n in zip(AXES, FREQUENCIES, target, strict=True)}
    return _within(points.withColumns(g), cutoff)


def insert_central_slices_3d(spectrum: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, sinc: float, blackman: float, cutoff: float = 0.5, ews_radius: Radius = 0.0, target: Shape | None = None, brick: int = BRICK, tile_pixels: int = TILE_PIXELS) -> DataFrame:
    """volume_id, kz, ky, kx, re, im, weight: every voxel gathers the slices near it (see slices_at). The window is at least one
    sample of the target's shortest side wide; target is the shape that the grid's frequencies refer to."""
    target = target or volume
    window = _least((sinc, blackman), min(target))
    form = (volume[0], volume[1], volume[2] // 2 + 1)
    edges = tuple(min(n, brick) for n in form)

    def frequencies(at: tuple[int, ...]) -> list[np.ndarray]:
        index = np.mgrid[tuple(slice(b * e, min(n, (b + 1) * e)) for b, e, n in zip(at, edges, form, strict=True))]
        return [i.ravel() - shift for i, shift in zip(index, (volume[0] // 2, volume[1] // 2, 0), strict=True)]

    def points(_, at: tuple[int, ...]):
        k = frequencies(at)
        yield len(k[0])
        for begin in range(0, len(k[0]), POINTS):
            g = [i[begin : begin + POINTS] / float(n) for i, n in zip(k, target, strict=True)]
            kept = np.flatnonzero(g[0] * g[0] + g[1] * g[1] + g[2] * g[2] <= cutoff * cutoff)
            yield begin + kept, np.stack(g)[:, kept], np.ones(len(kept))

    def named(volume_id, _, at: tuple[int, ...], seen: np.ndarray, sums: list[np.ndarray]):
        yield [volume_id], [*(k[seen] for k in frequencies(at)), *(v[seen] for v in sums)]

    keys = poses.select("volume_id", *[F.lit(0).cast("long").alias(k) for k in FREQUENCIES])
    units = tuple(-(-n // e) for n, e in zip(form, edges, strict=True))
    return _slice_sums(spectrum, poses, None, units, points, named, keys, shape, *window, ews_radius, tile_pixels)


def insert_central_slices_3d_joined(spectrum: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, sinc: float, blackman: float, cutoff: float = 0.5, ews_radius: Radius = 0.0, target: Shape | None = None) -> DataFrame:
    """insert_central_slices_3d as a join of elements: a row for each voxel, slice near it and tap."""
    target = target or volume
    window = _least((sinc, blackman), min(target))
    return slices_at(_volume_points(poses, volume, cutoff, target), spectrum, poses, ["volume_id", *FREQUENCIES], shape, *window, ews_radius)


def _slice_points(poses: DataFrame, shape: Shape, ews_radius: Radius, window: tuple[float, float], depth: int, cutoff: float) -> DataFrame:
    """The frequencies of every output slice on the grid: out_id, volume_id, ky, kx, gz, gy, gx (poses: matrix forward), each
    once for every sample of a volume of that depth along z in which the window isn't 0, with the window there."""
    _, h, w = shape
    points = _posed(poses).withColumnRenamed("image_id", "out_id")
    for k, lo, hi in (("ky", -(h // 2), (h - 1) // 2), ("kx", 0, w // 2)):
        points = points.withColumn(k, F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))))
    placed = _slice_to_grid(points, F.col("ky") / float(h), F.col("kx") / float(w), ews_radius)
    sinc, blackman = _least(window, depth)
    n = max(1, math.ceil(blackman * depth - 1e-6)) - 1
    if n == 0:
        return _within(placed.withColumn("window", F.lit(1.0)), cutoff)
    stepped = placed.withColumn("_step", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    step = F.col("_step") / float(depth)
    return _within(stepped.withColumns({"gz": F.col("gz") + step, "window": windowed_sinc(step, sinc, blackman)}).drop("_step"), cutoff)


def extract_central_slices_3d(volumes: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, cutoff: float = 0.5, ews_radius: Radius = 0.0, target: Shape | None = None, sinc: float = 0.0, blackman: float = 0.0) -> DataFrame:
    """out_id, ky, kx, re, im, weight: slices read from half spectra of volumes (image_id is the volume's) by interpolation.
    poses: image_id, volume_id, matrix (forward) and, where magnified, scaling (the inverse). Where blackman exceeds a sample of
    the volume, each value is summed along the volume's z under a windowed sinc, which masks the volume's depth in real space;
    the weight has what the windows sum to, or the sum of the volume's own column `weight` read the same way."""
    target = target or volume
    points = _slice_points(poses, shape, ews_radius, (sinc, blackman), target[0], cutoff)
    targets = points.select(F.col("volume_id").alias("image_id"), "out_id", "ky", "kx", "window", *[(F.col(f"g{a}") * float(n)).alias(f"f{a}") for a, n in zip(AXES, target, strict=True)])
    weighted = "weight" in volumes.columns
    keys = ["out_id", "ky", "kx"]
    return _summed(spectrum_gather(volumes, targets, keys, volume, "window", weighted), targets, keys, weighted)


def _slices_at_slices(spectrum: DataFrame, inserted: DataFrame, extracted: DataFrame, shape: Shape, window: tuple[float, float], ews_radius: Radius, depth_window: tuple[float, float], depth: int, cutoff: float, tile_pixels: int) -> DataFrame:
    """slices_at of _slice_points, which tasks work out from blocks of poses: out_id, ky, kx, re, im, weight."""
    form = (1, shape[1], shape[2] // 2 + 1)
    tile = tile_shape(form, (0, 0, 0), tile_pixels)
    scaled = ("scaling",) if "scaling" in extracted.columns else ()
    along = _least(depth_window, depth)
    n = max(1, math.ceil(along[1] * depth - 1e-6)) - 1
    steps = np.arange(-n, n + 1) / float(depth)
    windows = _sinc_windows(steps, *along) if n else np.ones(1)
    radii = ews_radius if isinstance(ews_radius, tuple) else (ews_radius, ews_radius)

    def frequencies(at: tuple[int, ...]) -> list[np.ndarray]:
        y, x = (i.ravel() for i in np.mgrid[tuple(slice(b * t, min(m, (b + 1) * t)) for b, t, m in zip(at[1:], tile[1:], form[1:], strict=True))])
        return [y - shape[1] // 2, x]

    def points(outs: pa.Array, at: tuple[int, ...]):
        ky, kx = frequencies(at)
        yield len(outs) * len(ky)
        matrices = _stacked(outs.field("matrix"), (3, 3))[:, :, :, None]
        scalings = _stacked(outs.field("scaling"), (2, 2))[:, :, :, None] if scaled else None
        many = max(1, POINTS // (len(ky) * len(steps)))
        each = max(1, POINTS // (len(ky) * many))
        for begin in range(0, len(outs), many):
            m = matrices[begin : begin + many]
            sy, sx = (np.broadcast_to(f, (len(m), len(f))) for f in (ky / float(shape[1]), kx / float(shape[2])))
            if scaled:
                s = scalings[begin : begin + many]
                sy, sx = (s[:, i, 0] * sy + s[:, i, 1] * sx for i in range(2))
            high = sum(f * f / (2 * r) if r else np.zeros_like(f) for f, r in zip((sy, sx), radii, strict=True))
            gz, gy, gx = (m[:, i, 0] * high + m[:, i, 1] * sy + m[:, i, 2] * sx for i in range(3))
            number = begin * len(ky) + np.arange(gz.size).reshape(gz.shape)
            for k in range(0, len(steps), each):
                z = gz + steps[k : k + each, None, None]
                held = [np.broadcast_to(a, z.shape) for a in (gy, gx, number, windows[k : k + each, None, None])]
                kept = z * z + held[0] * held[0] + held[1] * held[1] <= cutoff * cutoff
                yield held[2][kept], np.stack([z[kept], held[0][kept], held[1][kept]]), held[3][kept]

    def named(_, outs: pa.Array, at: tuple[int, ...], seen: np.ndarray, sums: list[np.ndarray]):
        ky, kx = frequencies(at)
        for image, there, *own in zip(outs.field("image_id").to_pylist(), *(v.reshape(len(outs), len(ky)) for v in (seen, *sums)), strict=True):
            yield [image], [ky[there], kx[there], *(v[there] for v in own)]

    keys = extracted.select(F.col("image_id").alias("out_id"), *[F.lit(0).cast("long").alias(k) for k in FREQUENCIES[1:]])
    units = tuple(-(-m // t) for m, t in zip(form, tile, strict=True))
    return _slice_sums(spectrum, inserted, _dealt(extracted, *scaled)[1], units, points, named, keys, shape, *window, ews_radius, tile_pixels)


def insert_and_extract_central_slices_3d(spectrum: DataFrame, inserted: DataFrame, extracted: DataFrame, shape: Shape, sinc: float, blackman: float, cutoff: float = 0.5, correct_weights: bool = False, ews_radius: Radius = 0.0, depth_window: tuple[float, float] = (0.0, 0.0), add_to: DataFrame | None = None, tile_pixels: int = TILE_PIXELS) -> DataFrame:
    """out_id, ky, kx, re, im, weight: output slices (extracted: forward matrices) gathered straight from the input slices
    (inserted: inverse matrices), without a volume between. depth_window (sinc, blackman) sums along the depth of that volume, as
    deep as a slice's shorter side. correct_weights divides by max(1, abs(weight)), which needs all slices in one call; add_to
    holds what earlier calls gave, and is added."""
    if correct_weights and add_to is not None:
        raise ValueError("weights are corrected once all slices are in, not while adding")
    depth = min(shape[1:])
    keys = ["out_id", "ky", "kx"]
    found = _slices_at_slices(spectrum, inserted, extracted, shape, _least((sinc, blackman), depth), ews_radius, depth_window, depth, cutoff, tile_pixels)
    if add_to is not None:
        both = found.unionByName(add_to.select(*keys, "re", "im", "weight"))
        return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("re", "im", "weight")])
    if not correct_weights:
        return found
    by = F.greatest(F.lit(1.0), F.abs("weight"))
    return found.withColumns({"re": F.col("re") / by, "im": F.col("im") / by})


def fourier_interpolation_correction(pixels: DataFrame, shape: Shape, post: bool = True) -> DataFrame:
    """Real-space values divided (post) or multiplied by the squared sinc that linear interpolation in Fourier space
    costs."""
    total = F.lit(0.0)
    for a, n in zip(AXES, shape, strict=True):
        if n > 1:
            total = total + F.pow((F.col(a) - n / 2.0) / float(n), 2)
    r = math.pi * F.sqrt(total)
    sinc = F.when(r == 0, 1.0).otherwise(F.sin(r) / F.when(r != 0, r))
    return pixels.withColumn("v", F.try_divide(F.col("v"), sinc * sinc) if post else F.col("v") * sinc * sinc)
