"""Operators against numpy on small images, and the properties that tie them together."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import borders, ctf
from lamina.operators import correlation as X
from lamina.operators import fourier as T
from lamina.operators import generators as G
from lamina.operators import geometry as M
from lamina.operators import neighbourhoods as N
from lamina.operators import projection as J
from lamina.operators import reductions as R
from lamina.operators import reshape as S
from lamina.operators import shells as H
from lamina.operators import spectra as P
from lamina.operators import subregions as B
from lamina.queries import volumes
from lamina.sources import mrc, stacks

STACK = "image_id long, d int, h int, w int, values array<double>"
RNG = np.random.default_rng(5)


def make(spark, images):
    rows = [(k, *a.shape, a.ravel().tolist()) for k, a in enumerate(images)]
    return spark.createDataFrame(rows, STACK)


def dense(pixels, shape, image=0):
    out = np.zeros(shape)
    for r in pixels.collect():
        if r["image_id"] == image:
            out[r["z"] if "z" in r else 0, r["y"], r["x"]] = r["v"]
    return out


@pytest.mark.parametrize("shape", [(1, 4, 4), (1, 5, 3), (3, 4, 5), (1, 1, 1), (2, 3, 2)])
def test_round_trips(spark, shape):
    a = RNG.normal(size=shape)
    stack = make(spark, [a])
    pixels = S.stack_to_pixels(stack)
    assert np.allclose(dense(pixels, shape), a)
    back = S.pixels_to_stack(pixels, shape).collect()[0]["values"]
    assert np.allclose(back, a.ravel())
    for norm in T.NORMS:
        spectra = T.fft_r2c(stack, norm)
        r = spectra.collect()[0]
        assert np.allclose(np.array(r["re"]) + 1j * np.array(r["im"]), np.fft.rfftn(a, norm=norm).ravel())
        rows = T.to_frequencies(spectra, shape)
        again = T.fft_c2r(T.from_frequencies(rows, shape), norm).collect()[0]["values"]
        assert np.allclose(again, a.ravel())


@pytest.mark.parametrize("shape", [(1, 4, 4), (1, 5, 3), (2, 3, 4)])
def test_direct_transform_equals_the_fast_one(spark, shape):
    stack = make(spark, [RNG.normal(size=shape), np.ones(shape)])
    key = ["image_id", "kz", "ky", "kx"]
    fast = {tuple(r[k] for k in key): (r["re"], r["im"]) for r in T.to_frequencies(T.fft_r2c(stack), shape).collect()}
    slow = {tuple(r[k] for k in key): (r["re"], r["im"]) for r in T.dft_join(S.stack_to_pixels(stack), shape).collect()}
    assert fast.keys() == slow.keys()
    assert all(np.allclose(fast[k], slow[k], atol=1e-9) for k in fast)


@pytest.mark.parametrize("shape", [(1, 4, 4), (1, 5, 5), (2, 4, 3)])
def test_layouts(spark, shape):
    a = RNG.normal(size=shape)
    half = T.to_frequencies(T.fft_r2c(make(spark, [a])), shape)
    full = np.fft.fftshift(np.fft.fftn(a, norm="forward"))
    got = np.zeros(shape, complex)
    rows = T.remap(half, shape, "h", "fc").collect()
    for r in rows:
        got[r["iz"], r["iy"], r["ix"]] = r["re"] + 1j * r["im"]
    assert len(rows) == a.size and np.allclose(got, full)
    back = T.remap(T.half_to_full(half, shape), shape, "f", "h").select(half.columns)
    assert back.exceptAll(half).count() == 0 and half.exceptAll(back).count() == 0


@pytest.mark.parametrize(("mode", "numpy_mode"), [("clamp", "edge"), ("periodic", "wrap"), ("mirror", "symmetric"), ("reflect", "reflect"), ("zero", "constant")])
def test_borders(spark, mode, numpy_mode):
    a = RNG.normal(size=(1, 4, 5))
    pixels = S.stack_to_pixels(make(spark, [a]))
    out = B.resize_stack(pixels, pixels.select("image_id").distinct(), a.shape, [(0, 0), (2, 3), (1, 2)], mode)
    assert np.allclose(dense(out, (1, 9, 8)), np.pad(a, [(0, 0), (2, 3), (1, 2)], mode=numpy_mode))


def test_border_of_one(spark):
    row = spark.range(1).select(borders.border_index(F.lit(-3), 1, "reflect").alias("r"), borders.border_index(F.lit(5), 1, "mirror").alias("m")).first()
    assert (row["r"], row["m"]) == (0, 0)


def test_centered_border():
    assert B.centered_border((1, 4, 5), (1, 7, 4)) == [(0, 0), (1, 2), (0, -1)]


def test_subregion(spark):
    a = np.arange(60.0).reshape(3, 4, 5)
    pixels = S.stack_to_pixels(make(spark, [a]))
    cases = [((Ellipsis, slice(1, -1, 2)), a[..., 1:-1:2]), ((-1,), a[-1:]), ((slice(None), 2, slice(-3, None)), a[:, 2:3, -3:])]
    for spec, want in cases:
        assert np.allclose(dense(S.subregion(pixels, a.shape, *spec), want.shape), want)
    with pytest.raises(IndexError):
        S.subregion(pixels, a.shape, 3)


def test_errors(spark):
    stack = make(spark, [np.ones((1, 2, 2))])
    with pytest.raises(Exception, match="values"):
        S.reshape(stack, (1, 3, 3)).collect()
    with pytest.raises(Exception, match="out of range"):
        S.copy_batches(stack, spark.createDataFrame([(0, 9)], "out_pos long, image_id long")).collect()
    with pytest.raises(ValueError):
        S.broadcast_stack(S.stack_to_pixels(stack), (1, 2, 2), (1, 3, 2))
    with pytest.raises(ValueError):
        M.symmetry_order("D2")


def test_cast(spark):
    df = spark.createDataFrame([(v,) for v in (-300.7, -1.5, 1.5, 300.2, float("nan"))], "v double")
    got = [r[0] for r in df.select(S.cast_value(F.col("v"), "int8")).collect()]
    assert got == [-128, -1, 1, 127, 0]
    assert [r[0] for r in df.select(S.cast_value(F.col("v"), "int8", clamp=False)).collect()] == [None, -1, 1, None, 0]


def test_reductions_and_ties(spark):
    a = np.array([[[1.0, 3.0], [3.0, -2.0]]])
    pixels = S.stack_to_pixels(make(spark, [a, np.full((1, 2, 2), 5.0)]))
    row = R.reduce(pixels, ["image_id"], "sum", "mean", "variance_1", "mean_l2_norm", "median").orderBy("image_id").first()
    assert np.allclose(tuple(row)[1:], (a.sum(), a.mean(), a.var(ddof=1), np.linalg.norm(a - a.mean()), np.median(a)))
    place = F.col("y") * 2 + F.col("x")
    assert R.argument(pixels, ["image_id"], place).orderBy("image_id").first()["place"] == 1
    assert R.argument(pixels, ["image_id"], place, largest=False).orderBy("image_id").first()["place"] == 3


def test_constant_images_normalize_to_null(spark):
    stack = make(spark, [np.full((1, 2, 2), 5.0)])
    assert R.normalize_dense(stack, "mean_std").first()["values"] == [None] * 4
    assert all(r["v"] is None for r in R.normalize(S.stack_to_pixels(stack), "min_max").collect())


@pytest.mark.parametrize("mode", list(R.NORMALIZED))
def test_dense_and_relational_normalizing_agree(spark, mode):
    stack = make(spark, [RNG.normal(size=(1, 4, 4)) for _ in range(3)])
    one = {(r["image_id"], r["y"], r["x"]): r["v"] for r in S.stack_to_pixels(R.normalize_dense(stack, mode)).collect()}
    two = {(r["image_id"], r["y"], r["x"]): r["v"] for r in R.normalize(S.stack_to_pixels(stack), mode).collect()}
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], abs_tol=1e-9) for k in one)


def test_accurate_sum(spark):
    values = np.array([1e16, 1.0, -1e16, 1.0]).reshape(1, 1, 4)
    row = R.reduce_accurate(S.stack_to_pixels(make(spark, [values])), ["image_id"]).first()
    assert row["sum"] == 2.0 and row["mean"] == 0.5


CANCELLING = [1e16, 1.0, -1e16, 1.0, 1e-300, 2.0**900, -(2.0**900), 5e-324, -0.0, 0.1, 3e-200, -7.25]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_accurate_sum_over_images(spark, parts):
    rows = [(k % 2, k, v * (1 + k % 3)) for k in range(60) for v in (CANCELLING if k % 2 else [1e16, 1.0, -1e16, 1.0])]
    pixels = spark.createDataFrame(rows, "label long, image_id long, v double").repartition(parts)
    for keys in ([], ["label"], ["label", "image_id"]):
        groups = {}
        for label, image, v in rows:
            groups.setdefault((label, image)[: len(keys)], []).append(v)
        got = {tuple(r[k] for k in keys): (r["sum"], r["mean"]) for r in R.reduce_accurate(pixels, keys).collect()}
        exact = {k: sum(map(Fraction, v)) for k, v in groups.items()}
        assert got == {k: (float(x), float(x / len(groups[k]))) for k, x in exact.items()}
        assert all(got[k][0] == math.fsum(v) for k, v in groups.items())


def test_accurate_sum_of_odd_values(spark):
    inf, nan = math.inf, math.nan
    groups = {0: [inf, 1.0], 1: [inf, -inf], 2: [nan, 1.0], 3: [-inf], 4: [0.0, -0.0], 5: [None, 2.0], 6: [1.7e308, 1.7e308]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    got = {r["k"]: r["sum"] for r in R.reduce_accurate(spark.createDataFrame(rows, "k long, v double"), ["k"]).collect()}
    assert got[0] == inf and math.isnan(got[1]) and math.isnan(got[2]) and got[3] == -inf and got[4] == 0.0 and got[5] == 2.0 and got[6] == inf
    assert R.reduce_accurate(spark.createDataFrame([], "k long, v double"), ["k"]).count() == 0


@pytest.mark.parametrize("keys", [[], ["label"], ["label", "image_id"]])
def test_user_reductions(spark, monkeypatch, keys):
    monkeypatch.setattr(R, "JOINED_TASKS", 2)
    monkeypatch.setattr(R, "HELD_GROUPS", 5)
    rows = [(["a", None, "b"][k % 3], k % 11, float(v)) for k, v in enumerate(RNG.normal(size=400))]
    pixels = spark.createDataFrame(rows, "label string, image_id long, v double").repartition(9)
    largest = R.Reduction((0.0, -math.inf), lambda s, v: (s[0] + len(v), max(s[1], float(v.max()))), lambda a, b: (a[0] + b[0], max(a[1], b[1])), lambda s: s[0] * 1000 + s[1])
    groups = {}
    for label, image, v in rows:
        groups.setdefault((label, image)[: len(keys)], []).append(v)
    for reduction, want in ((largest, lambda v: len(v) * 1000 + max(v)), (volumes.SPREAD, np.std)):
        got = {tuple(r[k] for k in keys): r["value"] for r in R.reduce_axes_ewise(pixels, keys, reduction).collect()}
        assert got.keys() == groups.keys() and all(math.isclose(got[k], want(v), abs_tol=1e-12) for k, v in groups.items())


def test_filters_agree(spark):
    a = RNG.normal(size=(1, 6, 5))
    stack = make(spark, [a])
    pixels = S.stack_to_pixels(stack)
    kernel = RNG.normal(size=(3, 3))
    for border in ("zero", "reflect"):
        one = dense(S.stack_to_pixels(N.convolve_dense(stack, kernel, border)), a.shape)
        assert np.allclose(one, dense(N.convolve(pixels, a.shape, kernel, border), a.shape))
        one = dense(S.stack_to_pixels(N.median_filter_dense(stack, (1, 3, 3), border)), a.shape)
        assert np.allclose(one, dense(N.median_filter(pixels, a.shape, (1, 3, 3), border), a.shape))
    line = [0.2, 0.5, 0.1]
    outer = np.outer(line, line)
    assert np.allclose(dense(N.convolve_separable(pixels, {"y": line, "x": line}), a.shape), dense(N.convolve(pixels, a.shape, outer), a.shape))
    with pytest.raises(ValueError):
        N.convolve(pixels, a.shape, np.ones((2, 2)))


def test_boxes_paste_back(spark):
    a = RNG.normal(size=(1, 6, 6))
    pixels = S.stack_to_pixels(make(spark, [a]))
    boxes = spark.createDataFrame([(0, 0, 0, -1, 2), (1, 0, 0, 3, 4)], "box_id long, image_id long, oz long, oy long, ox long")
    cut = B.extract_subregions(pixels, boxes, a.shape, (1, 3, 3))
    assert cut.count() == 18 and cut.filter("box_id = 0 and y = 0 and v <> 0").count() == 0
    assert B.extract_subregions(pixels, boxes, a.shape, (1, 3, 3), "nothing").count() == 12
    blank = pixels.withColumn("v", F.lit(0.0))
    back = dense(B.insert_subregions(blank, cut, boxes), a.shape)
    assert np.allclose(back[0, :2, 2:5], a[0, :2, 2:5]) and np.allclose(back[0, 3:, 4:], a[0, 3:, 4:])


def test_standardized_spectra(spark):
    a = RNG.normal(size=(1, 6, 5)) + 7
    for norm in T.NORMS:
        s = T.to_frequencies(T.fft_r2c(make(spark, [a]), norm), a.shape)
        back = np.array(T.fft_c2r(T.from_frequencies(P.standardize(s, a.shape, norm), a.shape), norm).first()["values"])
        assert abs(back.mean()) < 1e-9 and abs(back.std() - 1) < 1e-9


def test_known_shift_is_found(spark):
    y, x = np.mgrid[0:16, 0:16]
    a = np.exp(-((y - 7) ** 2 + (x - 8) ** 2) / 8.0)[None]
    s = T.to_frequencies(T.fft_r2c(make(spark, [a])), a.shape)
    moved = P.phase_shift(s, spark.createDataFrame([(0, 0.0, 1.4, -2.3)], "image_id long, sz double, sy double, sx double"), a.shape)
    maps = X.centered(S.stack_to_pixels(T.fft_c2r(T.from_frequencies(X.correlation_spectrum(X.zip_spectra(moved, s)), a.shape))), a.shape)
    found = X.peak(maps, a.shape).first()
    assert abs(found["y"] - 8 - 1.4) < 5e-2 and abs(found["x"] - 8 + 2.3) < 5e-2


def test_score_identities(spark):
    a, b = RNG.normal(size=(2, 1, 4, 4)) + 2
    pixels = S.stack_to_pixels(make(spark, [a, b]))
    zipped = pixels.filter("image_id = 0").join(pixels.filter("image_id = 1").select("z", "y", "x", F.col("v").alias("r")), ["z", "y", "x"])
    row = X.score(zipped).first()
    za, zb = a - a.mean(), b - b.mean()
    assert math.isclose(row["zncc"], (za * zb).sum() / np.sqrt((za**2).sum() * (zb**2).sum()))
    flat = S.stack_to_pixels(make(spark, [np.ones((1, 2, 2))])).withColumn("r", F.lit(1.0))
    assert X.score(flat).first()["zncc"] == 0.0


def test_shell_correlation_of_equal_spectra_is_one(spark):
    s = T.to_frequencies(T.fft_r2c(make(spark, [RNG.normal(size=(1, 8, 8)) * 100])), (1, 8, 8))
    assert all(abs(r["value"] - 1) < 1e-9 for r in X.fsc_isotropic(X.zip_spectra(s, s), (1, 8, 8)).collect())


def test_rotational_average_of_a_radial_spectrum(spark):
    s = T.to_frequencies(T.fft_r2c(make(spark, [np.eye(1, 64).reshape(1, 8, 8)])), (1, 8, 8))
    assert all(abs(r["value"] - 1 / 64**2) < 1e-12 for r in H.rotational_average(s, (1, 8, 8)).collect())


def test_anisotropic_ctf_without_astigmatism_is_isotropic(spark):
    table = spark.createDataFrame(
        [(0, 2.0, 2.0, 2.0, 1.5, 300.0, 0.1, 2.7, 0.2, -3.0, 1.0, 0.0, 0.4)],
        "image_id long, pixel_size double, pixel_y double, pixel_x double, defocus double, voltage double, amplitude double, cs double, phase_shift double, bfactor double, scale double, astigmatism double, astig_angle double",
    )
    fy, fx = F.lit(0.1), F.lit(0.2)
    f = F.sqrt(fy * fy + fx * fx)
    row = ctf.params(table).select(ctf.isotropic(f).alias("a"), ctf.anisotropic(fy, fx).alias("b"), ctf.isotropic_fftfreq(fy, fx).alias("f"), f.alias("g")).first()
    assert math.isclose(row["a"], row["b"], abs_tol=1e-12) and math.isclose(row["f"], row["g"], rel_tol=1e-6)
    assert math.isclose(ctf.params(table).first()["wavelength"], 0.019687, rel_tol=1e-4)


@pytest.mark.parametrize("kernel", [k for k in M.SIZES])
def test_dense_and_relational_gathers_agree(spark, kernel):
    a = RNG.normal(size=(1, 6, 6))
    stack = make(spark, [a]).withColumn("matrix", F.array(*[F.lit(v) for v in (0.9, 0.21, 0.37, -0.17, 0.95, 0.61)]))
    poses = stack.select("image_id", F.col("image_id").alias("out_id"), "matrix")
    for border in ("zero", "reflect", "periodic"):
        one = dense(S.stack_to_pixels(M.transform_2d_dense(stack, kernel, border).drop("matrix")), a.shape)
        out = M.transform_2d(S.stack_to_pixels(stack.drop("matrix")), poses, a.shape, kernel, border)
        two = dense(out.select(F.col("out_id").alias("image_id"), F.lit(0).alias("z"), "y", "x", "v"), a.shape)
        assert np.allclose(one, two, atol=1e-9)


@pytest.mark.parametrize("kernel", ["linear", "cubic", "cubic_bspline", "lanczos4", "lanczos6", "lanczos8"])
def test_weights_sum_to_one(kernel):
    f = np.array([0.0, 0.25, 0.5, 0.99])
    assert np.allclose(sum(M.weights(f, kernel, np)), 1)


def test_prefiltered_spline_passes_through_the_values(spark):
    a = RNG.normal(size=(1, 24, 24))
    c = np.array(M.cubic_bspline_prefilter(make(spark, [a])).first()["values"]).reshape(24, 24)
    y, x = np.mgrid[0:24, 0:24].astype(float)
    assert np.allclose(M.sample(c, y, x, "cubic_bspline", "clamp"), a[0], atol=1e-4)


def test_windows(spark):
    lines = spark.createDataFrame([(0,)], "image_id long")
    taps = [r["v"] for r in G.window(lines, "gaussian", 7, 1.5, normalize=True).orderBy("i").collect()]
    half = [r["v"] for r in G.window(lines, "gaussian", 7, 1.5, half=True, normalize=True).orderBy("i").collect()]
    assert math.isclose(sum(taps), 1) and np.allclose(half, taps[3:])


def test_random_stacks_repeat(spark):
    images = spark.range(3).select(F.col("id").alias("image_id"))
    one, two = (G.random_stack(images, (1, 20, 20), "poisson", 4.0).collect() for _ in range(2))
    assert one == two and abs(np.mean(one[0]["values"]) - 4) < 0.5


@pytest.mark.parametrize("dtype", ["int8", "uint8", "int16", "uint16", "float16", "float32"])
@pytest.mark.parametrize("shape", [(1, 3, 4), (2, 3, 4)])
def test_mrc_round_trip(dtype, shape):
    images = np.arange(2 * math.prod(shape), dtype=float).reshape(2, -1)
    found, spacing, data = mrc.decode(mrc.encode(images, shape, (1.5, 2.0, 2.5), dtype))
    assert found == (2, *shape) and np.allclose(data, images)
    assert np.allclose(spacing[1:], (2.0, 2.5))


def test_mrc_files(spark, tmp_path):
    stack = make(spark, [RNG.integers(0, 9, size=(1, 3, 3)).astype(float) for _ in range(4)]).withColumn("file", F.concat(F.lit("f"), (F.col("image_id") % 2).cast("string"), F.lit(".mrc")))
    assert mrc.save(mrc.to_files(stack, "file"), f"file://{tmp_path}").count() == 2
    back = mrc.read_mrc(spark, str(tmp_path)).filter(F.col("file").endswith("f1.mrc")).orderBy("image_id").collect()
    want = stack.filter("file = 'f1.mrc'").orderBy("image_id").collect()
    assert [r["values"] for r in back] == [r["values"] for r in want]


def test_volumes_and_slices(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 3, 4)
    stack = make(spark, [a, a + 100])
    stacks.write_stack(stack, str(tmp_path / "s"))
    planes = stacks.read_stack(spark, str(tmp_path / "s"), enforce_2d=True)
    assert planes.count() == 4 and planes.filter("volume_id = 1 and image_id = 1").first()["values"] == (a[1] + 100).ravel().tolist()
    assert stacks.read_slices(stack, 1, 1, 1, 1).first()["values"] == (a[1] + 100).ravel().tolist()


def test_empty_input(spark):
    empty = make(spark, []).filter("false")
    pixels = S.stack_to_pixels(empty)
    assert R.reduce(pixels, ["image_id"], "mean").count() == 0
    assert R.normalize(pixels, "mean_std").count() == 0
    assert N.median_filter(pixels, (1, 4, 4), (1, 3, 3)).count() == 0
    assert T.fft_r2c(empty).count() == 0
    assert S.pixels_to_stack(pixels, (1, 4, 4)).count() == 0


# --- kernels, projections, random values, large files -------------------------------------------------------------------


@pytest.mark.parametrize("kernel", ["linear", "cubic", "cubic_bspline", "lanczos4", "lanczos6", "lanczos8"])
def test_kernels_sum_to_one_and_keep_polynomials(kernel):
    f = np.linspace(0, 1, 11)[:-1]
    w = np.stack(M.weights(f, kernel, np))
    at = np.arange(len(w)) - (len(w) // 2 - 1)
    assert np.allclose(w.sum(axis=0), 1)
    if kernel in ("linear", "cubic", "cubic_bspline"):
        assert np.allclose((w * at[:, None]).sum(axis=0), f)
    if kernel == "cubic":
        assert np.allclose((w * at[:, None] ** 2).sum(axis=0), f * f)


@pytest.mark.parametrize("n", [2, 3, 8, 40])
def test_prefilter_solves_the_spline(n):
    line = RNG.normal(size=(3, n))
    c = M.prefilter_line(line)
    padded = np.pad(c, ((0, 0), (1, 1)), mode="edge")
    assert np.allclose((padded[:, :-2] + 4 * padded[:, 1:-1] + padded[:, 2:]) / 6, line)
    assert np.allclose(M.prefilter_line(np.ones(n)), 1)


@pytest.mark.parametrize("kernel", ["nearest", "linear", "cubic"])
def test_rays_sent_and_joined_agree(spark, kernel):
    volume, shape = (5, 6, 7), (1, 6, 5)
    held = make(spark, [RNG.normal(size=volume), RNG.normal(size=volume)])
    voxels = S.stack_to_pixels(held).filter("not (image_id = 1 and z = 2)")
    rows = [(k, k % 3, *a) for k, a in enumerate(RNG.uniform(-2, 2, size=(6, 3)).tolist())] + [(9, 0, 0.0, 0.0, 0.0)]
    i = spark.createDataFrame(rows, "image_id long, volume_id long, a double, b double, c double")
    turn = M.about(M.euler_matrix((F.col("a"), F.col("b"), F.col("c"))), [2.0, 3.0, 3.0], [F.lit(0.25)] * 3)
    poses = i.select("image_id", "volume_id", M.flattened(turn).alias("matrix"))
    both = [J.forward_project_3d(voxels, poses, shape, volume, 11, kernel, most_sent=n) for n in (J.MOST_SENT, 0)]
    sent, joined = ({(r["image_id"], r["y"], r["x"]): r["v"] for r in df.collect()} for df in both)
    assert sent and set(sent) == set(joined) and all(abs(v - joined[k]) < 1e-9 for k, v in sent.items())


def test_no_plan_sends_what_it_explodes(spark):
    volume, shape = (4, 4, 4), (1, 4, 4)
    voxels = S.stack_to_pixels(make(spark, [np.ones(volume)]))
    pixels = S.stack_to_pixels(make(spark, [np.ones(shape)]))
    poses = spark.range(1).select(F.col("id").alias("image_id"), F.col("id").alias("volume_id"), M.flattened(M.about(M.rotation("z", F.lit(0.1)), [2.0] * 3, [F.lit(0.0)] * 3)).alias("matrix"))
    backward = poses.withColumn("matrix", F.slice("matrix", 5, 8))
    spectra = T.to_frequencies(T.fft_r2c(make(spark, [np.ones(volume)])), volume)
    turns = poses.withColumn("matrix", M.flattened(M.rotation("z", F.lit(0.1))))
    for df in (
        J.forward_project_3d(voxels, poses, shape, volume, most_sent=0),
        J.backward_project_3d_joined(pixels, backward, shape, volume),
        J.extract_central_slices_3d(spectra, turns, shape, volume),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan
        for part in plan.split("BroadcastExchange")[1:]:
            assert "Generate explode(array(struct(i" not in part


def test_random_values_have_their_moments(spark):
    images = spark.range(40).select(F.col("id").alias("image_id"))
    for kind, a, b, mean, spread in [("uniform", -1, 1, 0, 1 / math.sqrt(3)), ("normal", 1, 2, 1, 2), ("poisson", 30, 0, 30, math.sqrt(30)), ("poisson", 0.5, 0, 0.5, math.sqrt(0.5))]:
        v = np.concatenate([r["values"] for r in G.random_stack(images, (1, 20, 20), kind, a, b).collect()])
        assert abs(v.mean() - mean) < 5 * spread / math.sqrt(len(v)) and abs(v.std() / spread - 1) < 0.03
    with pytest.raises(ValueError):
        G.random_stack(images, (1, 2, 2), "odd", 1)


def test_files_read_by_ranges(spark, tmp_path):
    rows = make(spark, [RNG.normal(size=(1, 6, 5)) for _ in range(5)]).withColumn("file", F.lit("one.mrc"))
    mrc.save(mrc.to_files(rows, "file"), str(tmp_path)).collect()
    whole, ranges = (sorted(map(str, mrc.read_mrc(spark, f"file://{tmp_path}", whole=n).collect())) for n in (1 << 20, 0))
    assert len(whole) == 5 and whole == ranges
