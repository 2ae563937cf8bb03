"""Contrast transfer functions as columns.

A CTF table has one row per image: image_id, pixel_size (A), defocus (um), voltage (kV), amplitude, cs (mm),
phase_shift (rad), bfactor (A^2), scale, and for anisotropic ones pixel_y, pixel_x, astigmatism (um), astig_angle (rad).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values (CODATA 2018): Planck constant (J s), speed of light (m/s), electron mass (kg), elementary charge (C).
PLANCK = 6.62607015e-34
LIGHT = 299792458.0
MASS = 9.1093837015e-31
CHARGE = 1.602176634e-19


def params(ctf: DataFrame) -> DataFrame:
    """ctf with wavelength (A), k1, k2, k3, defocus_a, astigmatism_a (A) and half_b added."""
    ev = CHARGE * F.col("voltage") * 1000.0
    wavelength = PLANCK * LIGHT / F.sqrt(ev * (2 * MASS * LIGHT * LIGHT + ev)) * 1e10
    wave = F.col("wavelength")
    a = F.col("amplitude")
    out = ctf.withColumn("wavelength", wavelength)
    added = {
        "k1": math.pi * wave,
        "k2": 0.5 * math.pi * F.col("cs") * 1e7 * wave * wave * wave,
        "k3": F.atan(a / F.sqrt(1 - a * a)),
        "defocus_a": -1e4 * F.col("defocus"),
        "b_quarter": F.col("bfactor") / 4,
    }
    if "astigmatism" in ctf.columns:
        added["astigmatism_a"] = -1e4 * F.col("astigmatism")
    return out.withColumns(added)


def phase(r2: Column, defocus: Column | None = None) -> Column:
    """The phase at squared frequency r2 (1 / A^2)."""
    d = F.col("defocus_a") if defocus is None else defocus
    return F.col("k1") * r2 * d + F.col("k2") * r2 * r2 - F.col("phase_shift") - F.col("k3")


def value(r2: Column, defocus: Column | None = None, squared: bool = False, absolute: bool = False) -> Column:
    out = -F.sin(phase(r2, defocus)) * F.exp(F.col("b_quarter") * r2) * F.col("scale")
    return out * out if squared else F.abs(out) if absolute else out


def isotropic(f: Column, **options) -> Column:
    """The CTF at frequency f (cycles a pixel)."""
    r = f / F.col("pixel_size")
    return value(r * r, **options)


def defocus_at(angle: Column) -> Column:
    return F.col("defocus_a") + F.col("astigmatism_a") * F.cos(2 * (angle - F.col("astig_angle")))


def anisotropic(fy: Column, fx: Column, **options) -> Column:
    """The CTF at the frequency vector (fy, fx) in cycles a pixel."""
    ry, rx = fy / F.col("pixel_y"), fx / F.col("pixel_x")
    return value(ry * ry + rx * rx, defocus_at(F.atan2(ry, rx)), **options)


def phase_inverse(target: Column) -> Column:
    """The frequency (1 / A) at which an isotropic CTF's phase reaches the target; null where it never does."""
    a, b = F.col("k2"), F.col("k1") * F.col("defocus_a")
    c = -(target + F.col("phase_shift") + F.col("k3"))
    discriminant = b * b - 4 * a * c
    root = F.when(discriminant >= 0, F.sqrt(F.greatest(discriminant, F.lit(0.0))))
    linear = F.when((a == 0) & (b != 0), -c / F.when(b != 0, b))
    # underfocus (defocus_a < 0) meets the target on the falling branch first
    r2 = F.when(a == 0, linear).otherwise(
        F.when(F.col("defocus_a") <= 0, (-b - root) / F.when(a != 0, 2 * a)).otherwise((-b + root) / F.when(a != 0, 2 * a))
    )
    return F.when(r2 >= 0, F.sqrt(F.greatest(r2, F.lit(0.0))))


def isotropic_fftfreq(fy: Column, fx: Column) -> Column:
    """The frequency (cycles a pixel) at which the CTF without astigmatism, with the mean pixel size, has the
    phase that the anisotropic one has at (fy, fx)."""
    ry, rx = fy / F.col("pixel_y"), fx / F.col("pixel_x")
    pixel = (F.col("pixel_y") + F.col("pixel_x")) / 2
    r2 = ry * ry + rx * rx
    at = phase(r2, defocus_at(F.atan2(ry, rx)))
    return F.coalesce(phase_inverse(at), F.sqrt(r2)) * pixel
