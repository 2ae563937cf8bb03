"""Forms for images and groups that fit no row and no task: tiles with halos, factored transforms, selected medians."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.borders import MODES, border_index, border_places
from lamina.operators import fourier as T
from lamina.operators import geometry as M
from lamina.operators import neighbourhoods as N
from lamina.operators import projection as J
from lamina.operators import reductions as R
from lamina.operators import reshape as S
from lamina.operators import subregions as B
from lamina.operators import tiles
from lamina.sources import mrc

from .test_operators import dense, make

RNG = np.random.default_rng(8)
PIXELS = "image_id long, z long, y long, x long, v double"


def pixels_of(spark, a, image=0):
    return spark.createDataFrame([(image, *map(int, at), float(a[at])) for at in np.ndindex(a.shape)], PIXELS)


def padded(a, halo, border):
    out = a
    for axis, (n, h) in enumerate(zip(a.shape, halo, strict=True)):
        at = border_places(np.arange(-h, n + h), n, border)
        out = np.take(out, np.clip(at, 0, None), axis)
        out[tuple(np.flatnonzero(at < 0) if k == axis else slice(None) for k in range(3))] = 0
    return out


@pytest.mark.parametrize("mode", MODES)
def test_places_are_border_index(spark, mode):
    i = np.arange(-9, 14)
    for n in (1, 2, 5):
        want = [r[0] for r in spark.createDataFrame([(int(k),) for k in i], "i long").select("i", border_index(F.col("i"), n, mode).cast("long").alias("j")).orderBy("i").select(F.coalesce("j", F.lit(-1))).collect()]
        assert border_places(i, n, mode).tolist() == want


@pytest.mark.parametrize("border", ["zero", "reflect", "clamp", "mirror", "periodic"])
@pytest.mark.parametrize("shape,window", [((1, 13, 10), (1, 5, 3)), ((5, 4, 7), (3, 3, 3)), ((1, 1, 9), (1, 1, 5)), ((1, 2, 11), (1, 3, 3))])
def test_tiles_join_up(spark, monkeypatch, border, shape, window):
    monkeypatch.setattr(tiles.tiled, "__defaults__", (None, 12, None))
    a = RNG.normal(size=shape)
    whole = padded(a, [n // 2 for n in window], border)
    view = np.lib.stride_tricks.sliding_window_view(whole, window)
    pixels = pixels_of(spark, a)
    assert np.allclose(dense(N.median_filter(pixels, shape, window, border), shape), np.median(view, axis=(3, 4, 5)))
    kernel = RNG.normal(size=window)
    assert np.allclose(dense(N.convolve(pixels, shape, kernel, border), shape), np.einsum("abcijk,ijk->abc", view, kernel))


def test_tiles_move_pixels_about_once(spark):
    shape = (1, 400, 300)
    a = spark.range(400 * 300).select(F.lit(0).cast("long").alias("image_id"), F.lit(0).cast("long").alias("z"), F.floor(F.col("id") / 300).alias("y"), (F.col("id") % 300).alias("x"), F.rand(1).alias("v"))
    entries = tiles.tile_entries(a, shape, (0, 2, 2), "reflect", tiles.tile_shape(shape, (0, 2, 2)))
    assert entries.agg(F.sum(F.size("entries"))).first()[0] < 1.06 * 400 * 300


def test_sparse_tiles(spark):
    pixels = spark.createDataFrame([(3, 0, 2, 2, 5.0), (4, 0, 0, 0, 1.0)], PIXELS)
    assert {tuple(r) for r in N.median_filter(pixels, (1, 30, 30), (1, 1, 1)).collect()} == {(3, 0, 2, 2, 5.0), (4, 0, 0, 0, 1.0)}
    assert N.convolve(pixels, (1, 30, 30), np.ones((3, 3))).agg(F.sum("v")).first()[0] == 5.0 * 9 + 4
    assert N.convolve(spark.createDataFrame([], PIXELS), (1, 4, 4), np.ones((3, 3))).count() == 0


@pytest.mark.parametrize("shape", [(1, 1, 1), (1, 1, 12), (1, 1, 15), (1, 6, 9), (1, 5, 7), (4, 3, 10)])
@pytest.mark.parametrize("norm", ["forward", "ortho", "backward"])
def test_factored_is_the_direct_transform(spark, shape, norm):
    stack = pixels_of(spark, RNG.normal(size=shape)).unionByName(pixels_of(spark, RNG.normal(size=shape), 1))
    key = ("image_id", "kz", "ky", "kx")
    one = {tuple(r[k] for k in key): complex(r["re"], r["im"]) for r in T.dft_factored(stack, shape, norm).collect()}
    two = {tuple(r[k] for k in key): complex(r["re"], r["im"]) for r in T.dft_join(stack, shape, norm).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_long_lines_are_short_in_tasks(spark):
    n = 4096
    a = RNG.normal(size=(1, 1, n))
    found = {r["kx"]: complex(r["re"], r["im"]) for r in T.dft_factored(pixels_of(spark, a), (1, 1, n), "backward").collect()}
    assert len(found) == n // 2 + 1 and np.allclose([found[k] for k in range(n // 2 + 1)], np.fft.rfft(a.ravel()))
    assert T._factors(n) == (64, 64) and T._factors(4095) == (63, 65) and T._factors(7) == (1, 7)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_selected_median(spark, monkeypatch, keys):
    monkeypatch.setattr(R, "SORTED_ROWS", 20)
    monkeypatch.setattr(R, "SPLITTERS", 8)
    skewed = np.concatenate([RNG.normal(size=800) ** 9 * 1e12, np.zeros(90), [1e300, -1e300]])
    groups = {None: [1.0, 2.0], 0: [7.0] * 300, 1: skewed.tolist(), 2: RNG.integers(0, 3, 501).astype(float).tolist(), 3: [5.0], 4: [math.inf, -math.inf, 0.5], 5: [None], 6: [0.0] * 40 + [1.0] * 40}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    pixels = spark.createDataFrame(rows, "k long, v double").repartition(5)
    want = {tuple(r[k] for k in keys): r["median"] for r in pixels.groupBy(*keys).agg(F.median("v").alias("median")).collect() if r["median"] is not None}
    got = {tuple(r[k] for k in keys): r["median"] for r in R.median_selected(pixels, keys).collect()}
    assert got == want
    assert R.median_selected(pixels.filter("false"), keys).count() == 0


def test_dense_filters_agree_with_tiles(spark):
    a = RNG.normal(size=(1, 9, 8))
    stack = make(spark, [a])
    assert np.allclose(dense(N.convolve(pixels_of(spark, a), a.shape, np.ones((3, 3))), a.shape), np.array(N.convolve_dense(stack, np.ones((3, 3))).first()["values"]).reshape(a.shape))


@pytest.mark.parametrize("mode", ["nothing", "value", "zero", "clamp", "mirror", "reflect", "periodic"])
@pytest.mark.parametrize("shape,box", [((1, 13, 10), (1, 4, 5)), ((4, 5, 6), (2, 3, 3)), ((1, 1, 7), (1, 1, 4))])
def test_boxes_are_cut_out_of_tiles(spark, mode, shape, box):
    a = RNG.normal(size=shape)
    absent = (shape[0] - 1, 0, shape[2] - 2)
    pixels = pixels_of(spark, a).filter(f"not (z = {absent[0]} and y = 0 and x = {absent[2]})")
    origins = [(k, k % 2, *(int(RNG.integers(-3, n + 2)) for n in shape)) for k in range(12)] + [(20 + k, 0, 0, 0, 1) for k in range(40)]
    boxes = spark.createDataFrame(origins, "box_id long, image_id long, oz long, oy long, ox long")
    got = {tuple(r[c] for c in ("box_id", "image_id", "z", "y", "x")): r["v"] for r in B.extract_subregions(pixels, boxes, shape, box, mode, 7.5, 6).collect()}
    want = {}
    for k, image, *origin in origins:
        index = [border_places(o + np.arange(m), n, "zero" if mode == "nothing" else mode) for o, m, n in zip(origin, box, shape, strict=True)]
        for at in np.ndindex(box):
            source = tuple(int(i[j]) for i, j in zip(index, at, strict=True))
            there = min(source) >= 0 and image == 0 and source != absent
            if there or mode != "nothing":
                want[(k, image, *at)] = a[source] if there else 7.5 if mode == "value" else 0.0
    assert got == want


def test_boxes_of_no_image_and_no_boxes(spark):
    pixels = pixels_of(spark, np.ones((1, 4, 4)))
    boxes = spark.createDataFrame([("b", 0, 0, 1, 1), (None, 5, 0, 0, 0)], "box_id string, image_id long, oz long, oy long, ox long")
    got = sorted(map(str, ((r["box_id"], r["v"]) for r in B.extract_subregions(pixels, boxes, (1, 4, 4), (1, 1, 2)).collect())))
    assert got == sorted(map(str, [("b", 1.0), ("b", 1.0), (None, 0.0), (None, 0.0)]))
    assert B.extract_subregions(pixels, boxes.filter("false"), (1, 4, 4), (1, 2, 2)).count() == 0
    assert B.extract_subregions(pixels.filter("false"), boxes, (1, 4, 4), (1, 2, 2), "nothing").count() == 0


def test_a_box_is_a_row_for_each_tile_before_its_join(spark):
    pixels = pixels_of(spark, np.ones((1, 20, 20)))
    boxes = spark.range(300).select(F.col("id").alias("box_id"), F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("oz"), (F.col("id") % 9).alias("oy"), (F.col("id") % 8).alias("ox"))
    assert B.extract_subregions(pixels, boxes, (1, 20, 20), (1, 12, 12)).count() == 300 * 144
    plan = B.extract_subregions(pixels, boxes, (1, 20, 20), (1, 12, 12))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("n,m,k,block", [(7, 5, 9, 4), (3, 3, 3, 64), (1, 8, 1, 3), (6, 6, 6, 1)])
def test_blocks_multiply(spark, n, m, k, block):
    a, b, c = RNG.normal(size=(n, m)), RNG.normal(size=(m, k)), RNG.normal(size=(n, k))
    df = lambda x: pixels_of(spark, x[None]).unionByName(pixels_of(spark, 2 * x[None], 1))
    for ta, tb in ((False, False), (True, False), (False, True), (True, True)):
        out = R.matmul(df(a.T if ta else a), df(b.T if tb else b), 1.5, 0.5, df(c), ta, tb, block)
        for image, scale in ((0, 1), (1, 2)):
            one = out.filter(f"image_id = {image}").select(F.lit(0).alias("image_id"), F.lit(0).alias("z"), "y", "x", "v")
            assert np.allclose(dense(one, (1, n, k))[0], 1.5 * scale**2 * a @ b + 0.5 * scale * c)


def test_blocks_of_sparse_and_infinite_matrices(spark):
    a = spark.createDataFrame([(0, 0, 0, 0, math.inf), (0, 0, 0, 5, 2.0), (0, 0, 3, 1, 1.0)], PIXELS)
    b = spark.createDataFrame([(0, 0, 0, 1, 3.0), (0, 0, 5, 2, 4.0), (0, 0, 5, 1, 1.0), (0, 0, 4, 4, 9.0)], PIXELS)
    for block in (2, 4, 64):
        assert {tuple(r) for r in R.matmul(a, b, block=block).collect()} == {(0, 0, 1, math.inf), (0, 0, 2, 8.0)}
    assert R.matmul(a.filter("false"), b).count() == 0


@pytest.mark.parametrize("shape,chunk", [((1, 1, 300), 64), ((1, 90, 7), 32), ((3, 40, 35), 32), ((1, 1, 1), 32), ((1, 2, 2), 32)])
def test_prefilter_in_chunks_is_the_whole_lines(spark, shape, chunk):
    a = RNG.normal(size=shape)
    want = np.array(M.cubic_bspline_prefilter(make(spark, [a])).first()["values"]).reshape(shape)
    got = dense(M.cubic_bspline_prefilter_pixels(pixels_of(spark, a), shape, chunk), shape)
    assert np.abs(got - want).max() < 1e-9


@pytest.mark.parametrize("kernel", ["nearest", "linear", "cubic", "cubic_bspline", "lanczos6"])
def test_bricks_sum_what_the_join_sums(spark, kernel):
    volume, shape = (5, 9, 7), (1, 11, 8)
    images = [RNG.normal(size=shape) for _ in range(5)]
    pixels = pixels_of(spark, images[0]).filter("not (y = 4 and x between 2 and 5)")
    for k, a in enumerate(images[1:], 1):
        pixels = pixels.unionByName(pixels_of(spark, a, k))
    rows = [(k % 6, k % 3, *a) for k, a in enumerate(RNG.uniform(-2, 2, size=(7, 3)).tolist())] + [(1, 7, 0.0, 0.0, 0.0)]
    i = spark.createDataFrame(rows, "image_id long, volume_id long, a double, b double, c double")
    turn = M.about(M.euler_matrix((F.col("a"), F.col("b"), F.col("c"))), [2.0, 4.0, 3.0], [F.lit(0.25), F.lit(0.5), F.lit(1.0)])[1:]
    poses = i.select("image_id", "volume_id", M.flattened(turn).alias("matrix"))
    held = lambda df: {(r["volume_id"], r["z"], r["y"], r["x"]): r["v"] for r in df.collect()}
    want = held(J.backward_project_3d_joined(pixels, poses, shape, volume, kernel))
    for brick, tile_pixels in ((3, 12), (32, 1 << 14)):
        got = held(J.backward_project_3d(pixels, poses, shape, volume, kernel, brick, tile_pixels))
        assert got.keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    assert J.backward_project_3d(pixels, poses.filter("false"), shape, volume, kernel).count() == 0


def test_brick_rows_follow_the_pairs_of_bricks_and_tiles(spark):
    plan = J.backward_project_3d(pixels_of(spark, np.ones((1, 8, 8))), spark.createDataFrame([(0, 0, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "image_id long, volume_id long, matrix array<double>"), (1, 8, 8), (8, 8, 8))
    assert plan.count() == 512 and "BroadcastExchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_batches_are_an_axis_too(spark):
    a = RNG.normal(size=(2, 1, 3, 4))
    pixels = pixels_of(spark, a[0]).unionByName(pixels_of(spark, a[1], 1)).withColumn("label", F.lit("x"))
    got = S.permute(pixels, ("y", "image_id", "z", "x"))
    assert got.columns == ["image_id", "z", "y", "x", "v"]
    assert {tuple(r) for r in got.collect()} == {(y, k, z, x, a[k, z, y, x]) for k, z, y, x in np.ndindex(a.shape)}
    with pytest.raises(ValueError):
        S.permute(pixels, ("z", "y", "x", "x"))


@pytest.mark.parametrize("dtype,mode", [("complex64", 4), ("complex_int16", 3)])
def test_complex_files(dtype, mode):
    images = RNG.normal(size=(3, 2 * 4 * 5)) * 1e5
    content = mrc.encode(images, (1, 4, 5), (1.0, 1.0, 1.0), dtype)
    assert int.from_bytes(content[12:16], "little") == mode and len(content) == mrc.HEADER + images.size * (4 if mode == 4 else 2)
    shape, _, data = mrc.decode(content)
    want = images.astype("f4") if mode == 4 else np.trunc(np.clip(images, -32768, 32767))
    assert shape == (3, 1, 4, 5) and np.array_equal(data, want)
    with pytest.raises(ValueError):
        mrc.encode(images, (1, 4, 10), (1.0, 1.0, 1.0), dtype)


@pytest.mark.parametrize("kernel", list(M.SIZES))
@pytest.mark.parametrize("shape", [(1, 6, 7), (4, 5, 6)])
def test_kernels_over_half_spectra(spark, kernel, shape):
    """Against loops over the whole window, each tap mirrored by itself (two taps: the frequency)."""
    image = RNG.normal(size=shape)
    full = np.fft.fftn(image)
    half = {k: full[tuple(i % n for i, n in zip(k, shape, strict=True))] for k in np.ndindex(shape[0], shape[1], shape[2] // 2 + 1)}
    half = {tuple(i - n if last < 2 and i > (n - 1) // 2 else i for last, (i, n) in enumerate(zip(k, shape, strict=True))): v for k, v in half.items()}
    spectrum = spark.createDataFrame([(0, *map(int, k), float(v.real), float(v.imag)) for k, v in half.items()], "image_id long, kz long, ky long, kx long, re double, im double")
    points = [tuple(0.0 if n == 1 else RNG.uniform(-n / 2, n / 2) for n in shape) for _ in range(60)] + [(0.0, 1.0, 0.25), (0.0, -2.0, -0.25), (0.0, 0.0, 0.0)]
    targets = spark.createDataFrame([(0, i, *p) for i, p in enumerate(points)], "image_id long, out_id long, fz double, fy double, fx double")
    got = {r["out_id"]: complex(r["re"], r["im"]) for r in M.spectrum_gather(spectrum, targets, ["out_id"], shape, kernel=kernel).collect()}
    size = M.SIZES[kernel]
    for i, p in enumerate(points):
        early = -1 if size <= 2 and p[2] < 0 else 1
        axes = []
        for f, n in zip(p, shape, strict=True):
            f, low = f * early, math.floor(f * early)
            if n == 1:
                axes.append([(0, 1.0)])
            elif kernel == "nearest":
                axes.append([(int(math.copysign(math.floor(abs(f) + 0.5), f)), 1.0)])
            else:
                axes.append([(low + 1 - size // 2 + k, float(w)) for k, w in enumerate(M.weights(np.array(f - low), kernel, np))])
        want = 0j
        for (z, wz), (y, wy), (x, wx) in ((a, b, c) for a in axes[0] for b in axes[1] for c in axes[2]):
            side = -1 if x < 0 else 1
            v = half.get((z * side, y * side, x * side), 0j)
            want += wz * wy * wx * (v.conjugate() if side * early < 0 else v)
        assert abs(got.get(i, 0j) - want) < 1e-9, (i, p)
