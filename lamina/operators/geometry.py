"""Geometric transforms: the output grid is carried to source coordinates, which gather by interpolation.

Relational: each coordinate becomes its taps (index and weight per axis), which meet the pixels in one equi-join
and are summed per output element. Dense: one image a row through numpy, for wide kernels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.borders import border_index
from ..functions.elementwise import times
from ..model import AXES, FREQUENCIES, Shape, grid, once
from .dense import arrays, dense, listed, pieces, shapes
from .tiles import TILE_PIXELS, tiled

#: Less of a value than this is what rounding leaves of none.
LEAST_SHARE = 1e-9
SIZES = {"nearest": 1, "linear": 2, "cubic": 4, "cubic_bspline": 4, "lanczos4": 4, "lanczos6": 6, "lanczos8": 8}


def b_spline(t, xp=F):
    """The uniform cubic B-spline of the distance t, as the fourth difference of the truncated power:
    sum over k of (-1)^k C(4, k) (t + 2 - k)^3 / 6 where the base is positive."""
    out = 0.0
    for k in range(4):
        base = t + (2 - k)
        cube = base * base * base
        held = np.where(base > 0, cube, 0.0) if xp is np else F.when(base > 0, cube).otherwise(0.0)
        out = out + ((-1) ** k * math.comb(4, k) / 6) * held
    return out


def hermite(f) -> list:
    """Weights of the four taps around a fraction f of the unit step, from the cubic Hermite basis: the curve passes
    through the two inner taps with the central differences as its slopes."""
    value_0, value_1 = (1 + 2 * f) * (1 - f) * (1 - f), f * f * (3 - 2 * f)
    slope_0, slope_1 = f * (1 - f) * (1 - f), f * f * (f - 1)
    return [-slope_0 / 2, value_0 - slope_1 / 2, value_1 + slope_0 / 2, slope_1 / 2]


def weights(f, kernel: str, xp=F):
    """The kernel's weights at fraction f, from the lowest tap up; columns (xp = F) or numpy arrays (xp = np)."""
    if kernel == "linear":
        return [1 - f, f]
    if kernel == "cubic":
        return hermite(f)
    if kernel == "cubic_bspline":
        return [b_spline(f - k, xp) for k in (-1, 0, 1, 2)]
    if kernel.startswith("lanczos"):
        size = SIZES[kernel]
        out = []
        for k in range(size):
            x = (k - (size // 2 - 1)) - f
            near = (xp.abs(x) < 1e-12) if xp is np else (F.abs(x) < 1e-12)
            safe = np.where(near, 1.0, x) if xp is np else F.when(near, 1.0).otherwise(x)
            w = xp.sin(math.pi * safe) * xp.sin(math.pi * safe / 4) * 4 / (math.pi * math.pi * safe * safe)
            out.append(np.where(near, 1.0, w) if xp is np else F.when(near, 1.0).otherwise(w))
        total = sum(out[1:], out[0])
        return [w / total for w in out]
    raise ValueError(f"unknown kernel {kernel}")


def taps(c: Column, kernel: str) -> Column:
    """Array of (i, w): the indices a coordinate reads along one axis."""
    if kernel == "nearest":
        return F.array(F.struct(F.round(c).cast("long").alias("i"), F.lit(1.0).alias("w")))
    low = F.floor(c).cast("long")
    first = 1 - SIZES[kernel] // 2
    return F.array(*[F.struct((low + (first + k)).alias("i"), w.alias("w")) for k, w in enumerate(weights(c - low, kernel))])


def gather(pixels: DataFrame, targets: DataFrame, keys: list[str], shape: Shape, kernel: str = "linear", border: str = "zero", sparse: bool = False, weight: str | None = None) -> DataFrame:
    """keys, v: for each target its source image interpolated at (cz, cy, cx), times a column `weight` if one is named, and
    summed over targets of equal keys.

    targets holds image_id, the keys and a coordinate for each axis longer than 1. sparse leaves out keys that
    nothing was read for; a share below LEAST_SHARE is rounding and reads nothing then.

    The pixels are the hashed side of the join (each key once, so its partitions are even), the taps stream by: what
    is made by exploding is never the side that is sent or held.
    """
    each = targets.withColumn("_w", F.col(weight) if weight else F.lit(1.0))
    for axis, n in zip(AXES, shape, strict=True):
        if n == 1:
            each = each.withColumn(f"_{axis}", F.lit(0).cast("long"))
            continue
        each = each.withColumn("_t", F.explode(taps(F.col(f"c{axis}"), kernel)))
        each = each.withColumns({f"_{axis}": border_index(F.col("_t.i"), n, border).cast("long"), "_w": F.col("_w") * F.col("_t.w")})
        if sparse:
            each = each.filter(F.col(f"_{axis}").isNotNull())
    if sparse:
        each = each.filter(F.abs("_w") >= LEAST_SHARE)
    source = pixels.select(F.col("image_id").alias("_image"), *[F.col(a).alias(f"_p{a}") for a in AXES], F.col("v").alias("_v")).hint("shuffle_hash")
    on = [each["image_id"] == source["_image"], *[each[f"_{a}"] == source[f"_p{a}"] for a in AXES]]
    got = each.join(source, on, "inner" if sparse else "left")
    return got.groupBy(*[each[k] for k in keys]).agg(F.sum(F.coalesce(F.col("_w") * F.col("_v"), F.lit(0.0))).alias("v"))


# --- poses ---------------------------------------------------------------------------------------------------


def rotation(axis: str, angle: Column) -> list[list[Column]]:
    """3 x 3 rotation about an axis, rows and columns in z, y, x order, counter-clockwise for a right-handed frame."""
    c, s, zero, one = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    return {
        "z": [[one, zero, zero], [zero, c, s], [zero, -s, c]],
        "y": [[c, zero, -s], [zero, one, zero], [s, zero, c]],
        "x": [[c, s, zero], [-s, c, zero], [zero, zero, one]],
    }[axis]


def product(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[sum((a[i][k] * b[k][j] for k in range(1, len(b))), a[i][0] * b[0][j]) for j in range(len(b[0]))] for i in range(len(a))]


def euler_matrix(angles: tuple[Column, Column, Column], axes: str = "zyx", intrinsic: bool = True, right_handed: bool = True) -> list[list[Column]]:
    """The rotation of three successive ones about the named axes."""
    turns = [rotation(axis, angle if right_handed else -angle) for axis, angle in zip(axes, angles, strict=True)]
    if not intrinsic:
        turns = turns[::-1]
    return product(product(turns[0], turns[1]), turns[2])


def rotation_2d(angle: Column) -> list[list[Column]]:
    """2 x 2 rotation, rows and columns in y, x order."""
    c, s = F.cos(angle), F.sin(angle)
    return [[c, s], [-s, c]]


def about(matrix: list[list[Column]], center: list[float], shift: list[Column]) -> list[list[Column]]:
    """Affine n x (n + 1): p -> center + matrix (p - center) + shift."""
    n = len(matrix)
    out = []
    for i in range(n):
        moved = sum((matrix[i][j] * F.lit(center[j]) for j in range(1, n)), matrix[i][0] * F.lit(center[0]))
        out.append([*matrix[i], F.lit(center[i]) - moved + shift[i]])
    return out


def scaling(factors: list[Column]) -> list[list[Column]]:
    """n x n, a factor for each axis."""
    return [[f if i == j else F.lit(0.0) for j in range(len(factors))] for i, f in enumerate(factors)]


def affine(matrix: list[list[Column]], shift: list[Column] | None = None) -> list[list[Column]]:
    """n x (n + 1): p -> matrix p + shift."""
    return [[*row, shift[i] if shift else F.lit(0.0)] for i, row in enumerate(matrix)]


def translation(shift: list[Column]) -> list[list[Column]]:
    """n x (n + 1): p -> p + shift."""
    return affine(scaling([F.lit(1.0)] * len(shift)), shift)


def composed(*steps: list[list[Column]]) -> list[list[Column]]:
    """The affine n x (n + 1) matrix that does the last of the given ones first."""
    out = steps[0]
    for step in steps[1:]:
        last = [F.lit(0.0)] * len(step) + [F.lit(1.0)]
        out = product(out, [*step, last])
    return out


def flattened(matrix: list[list[Column]]) -> Column:
    """A matrix as an array column, row by row."""
    return F.array(*[e.cast("double") for row in matrix for e in row])


def at(matrix: str, i: int, j: int, columns: int) -> Column:
    return F.get(matrix, F.lit(i * columns + j))


def apply(matrix: str, rows: int, vector: list[Column], columns: int | None = None) -> list[Column]:
    """matrix (an array column) times a vector of columns."""
    columns = columns or len(vector)
    return [sum((at(matrix, i, j, columns) * v for j, v in enumerate(vector[1:], 1)), at(matrix, i, 0, columns) * vector[0]) for i in range(rows)]


def transform_2d(pixels: DataFrame, poses: DataFrame, shape: Shape, kernel: str = "linear", border: str = "zero") -> DataFrame:
    """out(p) = in(M p) with M the inverse affine transform (`matrix`, 2 x 3) of poses. poses: out_id and image_id of
    its source, so one image can be transformed many times."""
    targets = grid(poses.select("out_id", "image_id", "matrix"), shape)
    cy, cx = apply("matrix", 2, [F.col("y"), F.col("x"), F.lit(1.0)])
    return gather(pixels, targets.withColumns({"cy": cy, "cx": cx}), ["out_id", "y", "x"], shape, kernel, border)


def transform_3d(pixels: DataFrame, poses: DataFrame, shape: Shape, kernel: str = "linear", border: str = "zero") -> DataFrame:
    """The same for volumes, with a 3 x 4 matrix."""
    targets = grid(poses.select("out_id", "image_id", "matrix"), shape)
    cz, cy, cx = apply("matrix", 3, [F.col("z"), F.col("y"), F.col("x"), F.lit(1.0)])
    return gather(pixels, targets.withColumns({"cz": cz, "cy": cy, "cx": cx}), ["out_id", "z", "y", "x"], shape, kernel, border)


def _border_numpy(i: np.ndarray, n: int, border: str) -> tuple[np.ndarray, np.ndarray]:
    inside = (i >= 0) & (i < n)
    if border == "clamp":
        return np.clip(i, 0, n - 1), np.ones_like(inside)
    if border == "periodic":
        return i % n, np.ones_like(inside)
    if border == "mirror":
        j = np.where(i < 0, -i - 1, i) % (2 * n)
        return np.where(j >= n, 2 * n - 1 - j, j), np.ones_like(inside)
    if border == "reflect":
        j = np.abs(i) % max(1, 2 * n - 2)
        return np.where(j >= n, 2 * n - 2 - j, j) if n > 1 else i * 0, np.ones_like(inside)
    return np.where(inside, i, 0), inside


def sample(image: np.ndarray, cy: np.ndarray, cx: np.ndarray, kernel: str = "linear", border: str = "zero") -> np.ndarray:
    """A 2-d image interpolated at coordinates."""
    out = np.zeros(cy.shape)
    axes = []
    for c, n in ((cy, image.shape[0]), (cx, image.shape[1])):
        if kernel == "nearest":
            low, ws = np.floor(np.abs(c) + 0.5).astype(int) * np.sign(c).astype(int), [np.ones_like(c)]
            first = 0
        else:
            low = np.floor(c).astype(int)
            ws, first = weights(c - low, kernel, np), 1 - SIZES[kernel] // 2
        axes.append([(*_border_numpy(low + first + k, n, border), w) for k, w in enumerate(ws)])
    for iy, oky, wy in axes[0]:
        for ix, okx, wx in axes[1]:
            out += np.where(oky & okx, image[iy, ix] * wy * wx, 0.0)
    return out


def transform_2d_dense(stack: DataFrame, kernel: str = "linear", border: str = "zero") -> DataFrame:
    """Each image of a stack with its own column `matrix` (2 x 3, inverse) transformed within its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = []
            for (h, w), values, matrix in zip(shapes(batch, "hw"), arrays(batch), arrays(batch, "matrix"), strict=True):
                y, x = np.mgrid[0:h, 0:w].astype(float)
                cy, cx = (m[0] * y + m[1] * x + m[2] for m in matrix.reshape(2, 3))
                found.append(sample(values.reshape(h, w), cy, cx, kernel, border).ravel())
            columns = [listed(found) if c == "values" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return stack.mapInArrow(run, stack.schema)


# --- polar grids, symmetry ---------------------------------------------------------------------------------------


def _along(i: Column, n: int, ends: tuple[float, float], endpoint: bool = False) -> Column:
    """The i-th of n even places from ends[0] to ends[1], that one included with endpoint."""
    return ends[0] + i * ((ends[1] - ends[0]) / max(1, n - 1 if endpoint else n))


TURN = (0.0, 2 * math.pi)


def cartesian2polar(pixels: DataFrame, images: DataFrame, shape: Shape, polar: tuple[int, int], center: tuple[float, float], rho: tuple[float, float], kernel: str = "linear", phi: tuple[float, float] = TURN, phi_endpoint: bool = False, rho_endpoint: bool = False) -> DataFrame:
    """Images on a grid of angles (rows) and radii (columns), each from the first to the second of its ends, which is left out
    unless asked for."""
    n_phi, n_rho = polar
    targets = grid(images.select("image_id"), (1, n_phi, n_rho)).withColumn("out_id", F.col("image_id"))
    angle, r = _along(F.col("y"), n_phi, phi, phi_endpoint), _along(F.col("x"), n_rho, rho, rho_endpoint)
    there = targets.withColumns({"cy": center[0] + r * F.sin(angle), "cx": center[1] + r * F.cos(angle)})
    return gather(pixels, there, ["out_id", "y", "x"], shape, kernel)


def polar2cartesian(polar_pixels: DataFrame, images: DataFrame, shape: Shape, polar: tuple[int, int], center: tuple[float, float], rho: tuple[float, float], kernel: str = "linear", phi: tuple[float, float] = TURN, phi_endpoint: bool = False, rho_endpoint: bool = False) -> DataFrame:
    """Back to an image of the given shape; what the polar grid doesn't cover is 0. The grid's angles begin within a turn
    of 0."""
    n_phi, n_rho = polar
    targets = grid(images.select("image_id"), shape).withColumn("out_id", F.col("image_id"))
    dy, dx = F.col("y") - center[0], F.col("x") - center[1]
    angle = F.atan2(dy, dx)
    angle = F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)
    rows = max(1, n_phi - phi_endpoint) / (phi[1] - phi[0])
    columns = max(1, n_rho - rho_endpoint) / (rho[1] - rho[0])
    there = targets.withColumns({"cy": (angle - phi[0]) * rows, "cx": (F.sqrt(dy * dy + dx * dx) - rho[0]) * columns})
    return gather(polar_pixels, there, ["out_id", "y", "x"], (1, n_phi, n_rho), kernel)


def symmetry_order(code: str) -> int:
    if not code[:1].upper() == "C" or not code[1:].isdigit() or int(code[1:]) < 1:
        raise ValueError(f"symmetry {code} is not supported")
    return int(code[1:])


def symmetrize(pixels: DataFrame, images: DataFrame, shape: Shape, code: str, center: tuple[float, ...], normalize: bool = True, kernel: str = "linear", pre: list[list[float]] | None = None, post: list[list[float]] | None = None) -> DataFrame:
    """Images (or volumes, about z) summed with their rotated copies of a C symmetry, divided by the order if normalize.
    post carries an output point to where it is symmetrized, pre the rotated point to where the input is read (3 x 4 in
    z, y, x order, as inverse transforms)."""
    n = symmetry_order(code)
    copies = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    targets = grid(images.select("image_id", copies.alias("_k")), shape).withColumn("out_id", F.col("image_id"))
    turn = F.col("_k") * (2 * math.pi / n)
    c, s = F.cos(turn), F.sin(turn)
    moved = lambda m, p: p if m is None else [m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] + m[i][3] for i in range(3)]
    z, y, x = moved(post, [F.col(a).cast("double") for a in AXES])
    dy, dx = y - center[-2], x - center[-1]
    at_input = moved(pre, [z, center[-2] + c * dy + s * dx, center[-1] - s * dy + c * dx])
    there = targets.withColumns({f"c{a}": v for a, v in zip(AXES, at_input, strict=True)})
    out = gather(pixels, there, ["out_id", *AXES], shape, kernel)
    return out.withColumn("v", F.col("v") / n) if normalize else out


# --- spectra -----------------------------------------------------------------------------------------------------


def spectrum_gather(spectrum: DataFrame, targets: DataFrame, keys: list[str], shape: Shape, weight: str | None = None, weighted: bool = False, kernel: str = "linear") -> DataFrame:
    """keys, re, im: half spectra interpolated at frequencies (fz, fy, fx, in samples), summed per keys and
    weighted by a column. A frequency with fx < 0 is read at its mirror and conjugated; fx closer to 0 than LEAST_SHARE is 0, so
    rounding doesn't choose the side (the two differ at the edge of even sizes, whose last frequency is kept once). Kernels of
    more than two taps reach over kx = 0, so each of their taps is mirrored by itself; taps outside the spectrum
    read 0. weighted reads the spectrum's own column `weight` likewise."""
    targets = once(targets, {"_fx": F.when(F.abs("fx") < LEAST_SHARE, 0.0).otherwise(F.col("fx"))}).withColumn("fx", F.col("_fx")).drop("_fx")
    wide = SIZES[kernel] > 2
    sign = F.lit(1.0) if wide else F.when(F.col("fx") < 0, -1.0).otherwise(1.0)
    each = targets.withColumns({"_s": sign, **{f: F.col(f) * sign for f in ("fz", "fy", "fx")}, "_w": F.col(weight) if weight else F.lit(1.0)})
    inside = {k: (0, n // 2) if k == "kx" else (-(n // 2), (n - 1) // 2) for k, n in zip(FREQUENCIES, shape, strict=True)}
    for f, k, n in zip(("fz", "fy", "fx"), FREQUENCIES, shape, strict=True):
        if n == 1:
            each = each.withColumn(f"_{k}", F.lit(0).cast("long"))
            continue
        each = each.withColumn("_t", F.explode(taps(F.col(f), kernel)))
        each = each.withColumns({f"_{k}": F.col("_t.i"), "_w": F.col("_w") * F.col("_t.w")})
        each = each.filter(F.col(f"_{k}").between(-(n // 2), n // 2) if wide else F.col(f"_{k}").between(*inside[k]))
    if wide:
        side = F.when(F.col("_kx") < 0, -1).otherwise(1)
        each = each.withColumns({"_s": side.cast("double"), **{f"_{k}": F.col(f"_{k}") * side for k in FREQUENCIES}})
        for k in FREQUENCIES:
            each = each.filter(F.col(f"_{k}").between(*inside[k]))
    source = spectrum.select(
        F.col("image_id").alias("_image"), *[F.col(k).alias(f"_q{k}") for k in FREQUENCIES], F.col("re").alias("_re"), F.col("im").alias("_im"), *([F.col("weight").alias("_own")] if weighted else [])
    ).hint("shuffle_hash")
    on = [each["image_id"] == source["_image"], *[each[f"_{k}"] == source[f"_q{k}"] for k in FREQUENCIES]]
    got = each.join(source, on)
    return got.groupBy(*[each[k] for k in keys]).agg(
        F.sum(F.col("_w") * F.col("_re")).alias("re"), F.sum(F.col("_w") * F.col("_im") * F.col("_s")).alias("im"),
        *([F.sum(F.col("_w") * F.col("_own")).alias("weight")] if weighted else []),
    )


def transform_spectrum_2d(spectrum: DataFrame, poses: DataFrame, shape: Shape, cutoff: float = 0.5, kernel: str = "linear") -> DataFrame:
    """out(k) = in(M k) times the phase of a shift afterwards; 0 (no row) above the cutoff. poses: out_id, image_id,
    matrix (2 x 2, inverse), sy, sx."""
    n = {k: float(v) for k, v in zip(FREQUENCIES, shape, strict=True)}
    points = spectrum.select("image_id", "ky", "kx").join(poses, "image_id")
    fy, fx = F.col("ky") / n["ky"], F.col("kx") / n["kx"]
    ty, tx = apply("matrix", 2, [fy, fx])
    kept = points.filter(F.sqrt(fy * fy + fx * fx) <= cutoff)
    targets = kept.select("out_id", "image_id", "ky", "kx", "sy", "sx", F.lit(0.0).alias("fz"), (ty * n["ky"]).alias("fy"), (tx * n["kx"]).alias("fx"))
    found = spectrum_gather(spectrum, targets, ["out_id", "ky", "kx", "sy", "sx"], shape, kernel=kernel)
    angle = -2 * math.pi * (F.col("sy") * F.col("ky") / n["ky"] + F.col("sx") * F.col("kx") / n["kx"])
    re, im = times((F.col("re"), F.col("im")), (F.cos(angle), F.sin(angle)))
    return found.select("out_id", "ky", "kx", re.alias("re"), im.alias("im"))


def transform_spectrum_3d(spectrum: DataFrame, poses: DataFrame, shape: Shape, cutoff: float = 0.5, kernel: str = "linear") -> DataFrame:
    """The same for volumes: matrix is 3 x 3, the shift sz, sy, sx."""
    f = [F.col(k) / float(n) for k, n in zip(FREQUENCIES, shape, strict=True)]
    points = spectrum.select("image_id", *FREQUENCIES).join(poses, "image_id")
    kept = points.filter(F.sqrt(f[0] * f[0] + f[1] * f[1] + f[2] * f[2]) <= cutoff)
    moved = apply("matrix", 3, f)
    shift = ["sz", "sy", "sx"]
    targets = kept.select("out_id", "image_id", *FREQUENCIES, *shift, *[(c * float(n)).alias(f"f{a}") for a, c, n in zip(AXES, moved, shape, strict=True)])
    found = spectrum_gather(spectrum, targets, ["out_id", *FREQUENCIES, *shift], shape, kernel=kernel)
    angle = -2 * math.pi * sum((F.col(s) * c for s, c in zip(shift[1:], f[1:], strict=True)), F.col("sz") * f[0])
    re, im = times((F.col("re"), F.col("im")), (F.cos(angle), F.sin(angle)))
    return found.select("out_id", *FREQUENCIES, re.alias("re"), im.alias("im"))


def spectrum2polar(spectrum: DataFrame, images: DataFrame, shape: Shape, polar: tuple[int, int], rho: tuple[float, float] = (0.0, 0.5), phi: tuple[float, float] = (0.0, math.pi), phi_endpoint: bool = False, rho_endpoint: bool = True, kernel: str = "linear") -> DataFrame:
    """Half spectra on a grid of angles (rows) and frequencies (columns, rho in cycles a pixel), each from the first to the
    second of its ends."""
    n_phi, n_rho = polar
    targets = grid(images.select("image_id"), (1, n_phi, n_rho))
    angle, r = _along(F.col("y"), n_phi, phi, phi_endpoint), _along(F.col("x"), n_rho, rho, rho_endpoint)
    there = targets.select("image_id", F.col("image_id").alias("out_id"), "y", "x", F.lit(0.0).alias("fz"), (r * F.sin(angle) * float(shape[1])).alias("fy"), (r * F.cos(angle) * float(shape[2])).alias("fx"))
    return spectrum_gather(spectrum, there, ["out_id", "y", "x"], shape, kernel=kernel)


def prefilter_line(lines: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients of each line (the last axis): the exact solution of the tridiagonal system that makes
    the spline pass through every sample, by elimination."""
    n = lines.shape[-1]
    if n < 2:
        return lines
    diagonal = np.full(n, 4.0)
    diagonal[[0, -1]] = 5.0
    right = 6.0 * lines
    for k in range(1, n):
        share = 1.0 / diagonal[k - 1]
        diagonal[k] -= share
        right[..., k] -= share * right[..., k - 1]
    right[..., -1] /= diagonal[-1]
    for k in range(n - 2, -1, -1):
        right[..., k] = (right[..., k] - right[..., k + 1]) / diagonal[k]
    return right


def cubic_bspline_prefilter(stack: DataFrame) -> DataFrame:
    """Each image's interpolation coefficients: lines are filtered along every axis longer than 1."""

    def one(image: np.ndarray) -> np.ndarray:
        for axis in range(3):
            if image.shape[axis] > 1:
                image = np.moveaxis(prefilter_line(np.moveaxis(image, axis, -1)), -1, axis)
        return image

    return dense(stack, one)


#: Elements after which a prefilter's answer to a value is below a double's rounding: it fades by sqrt(3) - 2 each element.
FADED = 32


def cubic_bspline_prefilter_pixels(pixels: DataFrame, shape: Shape, chunk: int = 1 << 10) -> DataFrame:
    """The same for whole images that fit no row, over pixels: each axis's lines in chunks of `chunk` elements with FADED more on
    each side, mirrored at the ends, so chunks need nothing of each other and all agree with the whole line to rounding."""
    for axis, n in enumerate(shape):
        if n > 1:
            one = [k == axis for k in range(3)]
            across = max(1, round((TILE_PIXELS / min(n, chunk)) ** (1 / max(1, sum(m > 1 for m in shape) - 1))))
            tile = tuple(min(m, max(chunk, FADED) if own else across) for m, own in zip(shape, one, strict=True))
            inner = tuple(slice(FADED, -FADED) if own else slice(None) for own in one)

            def lines(a: np.ndarray, axis: int = axis, inner: tuple = inner) -> np.ndarray:
                return np.moveaxis(prefilter_line(np.moveaxis(a, axis, -1)), -1, axis)[inner]

            halo = tuple(FADED if own else 0 for own in one)
            pixels = tiled(pixels, shape, halo, "mirror", lines, lambda there, inner=inner: np.ones(there[inner].shape, bool), tile=tile)
    return pixels
