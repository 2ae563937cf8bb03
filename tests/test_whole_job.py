"""Queries over all images, angles and frequencies against brute force."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from lamina.queries import QUERIES
from lamina.sources import mrc

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def images():
    if not DATA.exists():
        pytest.skip("no tables")
    found = duckdb.sql(f"select vec_id, embedding from '{DATA}/embeddings.parquet'").fetchall()
    return {k: np.array(v, float).reshape(8, 8) for k, v in found}


def _fit(m, axis, at):
    n = m.shape[axis]
    move = lambda s: m[tuple((a + s) % n if k == axis else a for k, a in enumerate(at))]
    a, b = (move(-1) + move(1) - 2 * m[at]) / 2, (move(1) - move(-1)) / 2
    fits = [(0.0, m[at])] if abs(a) < 1e-6 + 1e-12 else []  # at the bound of flatness either will do
    return fits + ([(-b / (2 * a), m[at] - b * b / (4 * a))] if abs(a) >= 1e-6 - 1e-12 else [])


def _peaks(m, inside):
    """Every peak that rounding may choose: its place and its value."""
    top = m[inside].max()
    for at in zip(*np.nonzero(inside & (m >= top - 1e-12)), strict=True):
        fits = [_fit(m, k, at) for k in range(m.ndim)]
        for chosen in fits[0] if m.ndim == 1 else [(y, x) for y in fits[0] for x in fits[1]]:
            each = [chosen] if m.ndim == 1 else chosen
            yield [*(a + f[0] for a, f in zip(at, each, strict=True)), sum(f[1] for f in each) / len(each)]


def test_peaks_of_all_images(spark, images):
    got = {r["image_id"]: [r["y"], r["x"], r["value"]] for r in QUERIES["cross_correlation_peak_2d_all"](spark, str(DATA)).collect()}
    assert set(got) == {k for k in images if k + 1 in images}
    y, x = np.mgrid[:8, :8] - 4
    for k, found in got.items():
        product = np.fft.fft2(images[k]) * np.conj(np.fft.fft2(images[k + 1]))
        m = np.roll(np.fft.ifft2(product).real / 64, (4, 4), (0, 1))
        assert any(np.allclose(found, p, atol=2e-6, rtol=1e-9) for p in _peaks(m, (y / 3) ** 2 + (x / 3) ** 2 <= 1)), k


def test_peaks_of_all_lines(spark, images):
    got = {r["image_id"]: [r["x"], r["value"]] for r in QUERIES["cross_correlation_peak_1d_all"](spark, str(DATA)).collect()}
    assert set(got) == {k * 8 + y for k in images if k + 1 in images for y in range(8)}
    for k, found in got.items():
        product = np.fft.fft(images[k // 8][k % 8]) * np.conj(np.fft.fft(images[k // 8 + 1][k % 8]))
        m = np.roll(np.fft.ifft(product).real / 8, 4)
        assert any(np.allclose(found, p, atol=2e-6, rtol=1e-9) for p in _peaks(m, np.ones(8, bool))), k


def test_modes_of_all_frequencies(spark, images):
    rows = QUERIES["cross_correlation_modes_all"](spark, str(DATA)).collect()
    assert len(rows) == 8 * 5 * (len(images) - 1)
    spectra = {k: np.fft.fft2(v) / 64 for k, v in images.items()}
    for r in rows:
        at = r["ky"] % 8, r["kx"]
        p = spectra[r["image_id"]][at] * np.conj(spectra[r["image_id"] + 1][at])
        s = abs(p)
        want = [p.real / (s + 1e-13), p.imag / (s + 1e-13), p.real / math.sqrt(s + 1e-13), (p.real**2 - p.imag**2) / (s + 1e-13)]
        assert np.allclose([r["re"], r["im"], r["mutual_re"], r["double_re"]], want, atol=2e-6, rtol=0), r


def test_polar_spectra_of_all_angles(spark, images):
    rows = QUERIES["spectrum2polar_all"](spark, str(DATA)).collect()
    assert len(rows) == 6 * 5 * len(images)
    spectra = {k: np.fft.fft2(v) / 64 for k, v in images.items()}
    for r in rows:
        f = spectra[r["image_id"]]
        fy, fx = (r["x"] * 0.1 * 8 * g(r["y"] * math.pi / 6) for g in (math.sin, math.cos))
        sign = -1 if fx < 0 else 1
        fy, fx, out = fy * sign, fx * sign, 0
        for ky in (math.floor(fy), math.floor(fy) + 1):
            for kx in (math.floor(fx), math.floor(fx) + 1):
                if -4 <= ky <= 3 and 0 <= kx <= 4:
                    out += (1 - abs(fy - ky)) * (1 - abs(fx - kx)) * f[ky % 8, kx]
        assert np.allclose([r["re"], r["im"]], [out.real, out.imag * sign], atol=2e-6, rtol=0), r


def test_slices_grow_with_the_table(spark, images):
    assert QUERIES["read_slices_middle"](spark, str(DATA)).select("image_id").distinct().count() == len(images) // 2


@pytest.mark.parametrize("shape", [(1, 3, 4), (1, 3, 5), (2, 3, 5)])
def test_packed_files(spark, shape):
    n = math.prod(shape)
    images = np.arange(2 * n, dtype=float).reshape(2, n) % 16
    content = mrc.encode(images, shape, (1.5, 2.0, 2.5), "uint4")
    assert len(content) == 1024 + 2 * shape[0] * shape[1] * ((shape[2] + 1) // 2)
    assert content[1024] == 0 | 1 << 4 and int.from_bytes(content[12:16], "little") == 101
    found, _, data = mrc.decode(content)
    assert found == (2, *shape) and (data == images).all()
    rows = mrc.from_files(spark.createDataFrame([("f", bytearray(content))], "path string, content binary")).orderBy("image_id").collect()
    assert [r["values"] for r in rows] == images.tolist()
    assert (mrc.decode(mrc.encode(images * 3 - 8.5, shape, (1.0, 1.0, 1.0), "uint4"))[2] == np.trunc(np.clip(images * 3 - 8.5, 0, 15))).all()
