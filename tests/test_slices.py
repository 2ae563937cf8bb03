"""Central slices in and out of volumes against plain loops: magnification, Ewald sphere, target shapes, weights, windows."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import projection as J

SLICE, VOLUME, TARGET = (1, 6, 5), (7, 6, 8), (9, 8, 10)
RADIUS = (1.3, 0.9)
SCALING = np.array([[1.04, 0.03], [-0.02, 0.95]])
CUTOFF = 0.43


def places(shape):
    d, h, w = shape
    return list(itertools.product(range(-(d // 2), (d - 1) // 2 + 1), range(-(h // 2), (h - 1) // 2 + 1), range(w // 2 + 1)))


def turn(a, b):
    z = np.array([[1, 0, 0], [0, math.cos(a), math.sin(a)], [0, -math.sin(a), math.cos(a)]])
    y = np.array([[math.cos(b), 0, -math.sin(b)], [0, 1, 0], [math.sin(b), 0, math.cos(b)]])
    return z @ y


TURNS = [turn(0.0, 0.0), turn(0.4, 0.3), turn(-0.7, 1.1), turn(2.0, -0.5)]


def window(f, sinc, blackman):
    return np.sinc(f / sinc) * (0.42 + 0.5 * math.cos(math.pi * f / blackman) + 0.08 * math.cos(2 * math.pi * f / blackman))


def bend(f):
    return f[0] ** 2 / (2 * RADIUS[0]) + f[1] ** 2 / (2 * RADIUS[1])


def read(known, f):
    """Value and weight of one half spectrum at a frequency in samples."""
    flip = f[2] < 0
    f = -np.asarray(f) if flip else np.asarray(f)
    value, weight = 0j, 0.0
    for step in itertools.product((0, 1), repeat=3):
        low = np.floor(f)
        share = np.prod([p if s else 1 - p for s, p in zip(step, f - low, strict=True)])
        v, w = known.get(tuple((low + step).astype(int)), (0j, 0.0))
        value, weight = value + share * v, weight + share * w
    return (value.conjugate() if flip else value), weight


def spectra(spark, shape, n, seed):
    """Spectra of real images: what lies at (-kz, -ky, 0) is the conjugate, so it doesn't matter to which side of the plane
    rounding puts a frequency."""
    rng = np.random.default_rng(seed)
    known = [{k: (complex(*rng.normal(size=2)), float(rng.uniform(0.5, 2))) for k in places(shape)} for _ in range(n)]
    for one in known:
        for kz, ky, kx in [k for k in one if k[2] == 0 and k > (0, 0, 0)]:
            if (-kz, -ky, 0) in one:
                v, w = one[kz, ky, kx]
                one[-kz, -ky, 0] = v.conjugate(), w
        one[0, 0, 0] = one[0, 0, 0][0].real + 0j, one[0, 0, 0][1]
    rows = [(i, *k, v.real, v.imag, w) for i, one in enumerate(known) for k, (v, w) in one.items()]
    return known, spark.createDataFrame(rows, "image_id long, kz long, ky long, kx long, re double, im double, weight double")


def poses(spark, matrices, scaling):
    rows = [(i, 0, m.ravel().tolist(), scaling.ravel().tolist()) for i, m in enumerate(matrices)]
    return spark.createDataFrame(rows, "image_id long, volume_id long, matrix array<double>, scaling array<double>")


def close(df, keys, want):
    got = {tuple(r[k] for k in keys): (complex(r["re"], r["im"]), r["weight"]) for r in df.collect()}
    assert got
    for k in set(got) | set(want):
        (a, b), (c, d) = got.get(k, (0j, 0.0)), want.get(k, (0j, 0.0))
        assert abs(a - c) < 1e-7 and abs(b - d) < 1e-7, k


def in_volume(ky, kx, matrix):
    f = SCALING @ [ky / SLICE[1], kx / SLICE[2]]
    return matrix @ [bend(f), *f]


@pytest.mark.parametrize("weighted", [True, False])
def test_rasterized(spark, weighted):
    known, rows = spectra(spark, SLICE, 4, 1)
    volume, want = set(places(VOLUME)), {}
    for one, matrix in zip(known, TURNS, strict=True):
        for (_, ky, kx), (v, w) in one.items():
            g = in_volume(ky, kx, matrix)
            if g @ g > CUTOFF**2:
                continue
            if g[2] < 0:
                g, v = -g, v.conjugate()
            f = g * TARGET
            low = np.floor(f)
            for step in itertools.product((0, 1), repeat=3):
                share = np.prod([p if s else 1 - p for s, p in zip(step, f - low, strict=True)])
                k = tuple((low + step).astype(int))
                copies = [(k, v)] + ([((-k[0], -k[1], 0), v.conjugate())] if k[2] == 0 else [])
                for at, value in copies:
                    if at in volume:
                        a, b = want.get(at, (0j, 0.0))
                        want[at] = a + share * value, b + share * (w if weighted else 1)
    out = J.rasterize_central_slices_3d(rows if weighted else rows.drop("weight"), poses(spark, TURNS, SCALING), SLICE, VOLUME, CUTOFF, RADIUS, TARGET)
    close(out, ("kz", "ky", "kx"), want)


def gathered(known, g, sinc, blackman, weighted):
    """Value and weight at a 3-d frequency, of all slices (inverse turns, magnification)."""
    value, weight, near = 0j, 0.0, False
    for one, matrix in zip(known, TURNS, strict=True):
        h = matrix.T @ g
        off = h[0] - bend(h[1:])
        if abs(off) > blackman:
            continue
        near = True
        y, x = np.linalg.inv(SCALING) @ h[1:] * SLICE[1:]
        v, w = read(one, (0, y, x))
        share = window(off, sinc, blackman)
        value, weight = value + share * v, weight + share * (w if weighted else 1)
    return value, weight, near


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("widths", [(0.15, 0.2), (0.01, 0.01)])
def test_inserted(spark, weighted, widths):
    known, rows = spectra(spark, SLICE, 4, 2)
    inverse = poses(spark, [m.T for m in TURNS], np.linalg.inv(SCALING))
    sinc, blackman = (max(w, 1 / 8) for w in widths)
    want = {}
    for k in places(VOLUME):
        g = np.array(k) / TARGET
        if g @ g <= CUTOFF**2:
            value, weight, near = gathered(known, g, sinc, blackman, weighted)
            if near:
                want[k] = value, weight
    out = J.insert_central_slices_3d(rows if weighted else rows.drop("weight"), inverse, SLICE, VOLUME, *widths, CUTOFF, RADIUS, TARGET)
    close(out, ("kz", "ky", "kx"), want)


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("widths", [(0.0, 0.0), (0.12, 0.31), (0.2, 2 / 9)])
def test_extracted(spark, weighted, widths):
    known, rows = spectra(spark, VOLUME, 1, 3)
    sinc, blackman = (max(w, 1 / 9) for w in widths)
    want = {}
    for i, matrix in enumerate(TURNS):
        for _, ky, kx in places(SLICE):
            value, weight, any_ = 0j, 0.0, False
            for step in range(-9, 10):
                if abs(step / 9) < blackman - 1e-9:
                    g = in_volume(ky, kx, matrix) + [step / 9, 0, 0]
                    if g @ g <= CUTOFF**2:
                        any_ = True
                        v, w = read(known[0], g * TARGET)
                        share = window(step / 9, sinc, blackman)
                        value, weight = value + share * v, weight + share * (w if weighted else 1)
            if any_:
                want[i, ky, kx] = value, weight
    out = J.extract_central_slices_3d(rows if weighted else rows.drop("weight"), poses(spark, TURNS, SCALING), SLICE, VOLUME, CUTOFF, RADIUS, TARGET, *widths)
    close(out, ("out_id", "ky", "kx"), want)


@pytest.mark.parametrize("depth", [(0.0, 0.0), (0.25, 0.5)])
def test_inserted_and_extracted(spark, depth):
    known, rows = spectra(spark, SLICE, 4, 4)
    inverse = poses(spark, [m.T for m in TURNS], np.linalg.inv(SCALING))
    forward = poses(spark, TURNS, SCALING)
    least = [max(d, 1 / 5) for d in depth]
    want = {}
    for i, matrix in enumerate(TURNS):
        for _, ky, kx in places(SLICE):
            for step in range(-5, 6):
                if abs(step / 5) < least[1] - 1e-9:
                    g = in_volume(ky, kx, matrix) + [step / 5, 0, 0]
                    value, weight, near = gathered(known, g, 0.2, 0.3, True)
                    if g @ g <= CUTOFF**2 and near:
                        share = window(step / 5, *least)
                        a, b = want.get((i, ky, kx), (0j, 0.0))
                        want[i, ky, kx] = a + share * value, b + share * weight
    give = lambda **more: J.insert_and_extract_central_slices_3d(rows, inverse, forward, SLICE, 0.1, 0.3, CUTOFF, ews_radius=RADIUS, depth_window=depth, **more)
    keys = ("out_id", "ky", "kx")
    close(give(), keys, want)
    close(give(correct_weights=True), keys, {k: (v / max(1, abs(w)), w) for k, (v, w) in want.items()})
    close(give(add_to=give()), keys, {k: (2 * v, 2 * w) for k, (v, w) in want.items()})
    with pytest.raises(ValueError):
        give(correct_weights=True, add_to=give())


def test_no_slices(spark):
    _, rows = spectra(spark, SLICE, 1, 5)
    none = poses(spark, TURNS[:1], SCALING).filter(F.lit(False))
    assert J.rasterize_central_slices_3d(rows, none, SLICE, VOLUME).count() == 0
    assert J.insert_central_slices_3d(rows, none, SLICE, VOLUME, 0.1, 0.1).count() == 0
    assert J.extract_central_slices_3d(rows, none, SLICE, VOLUME, blackman=0.4).count() == 0
