"""Queries of geometric transforms, projection, streaming and the jobs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import fourier as T
from ..operators import geometry as G
from ..operators import projection as J
from ..operators.reshape import pixels_to_stack, stack_to_pixels
from .base import ORACLE_SQL, PX, SHAPE, pixels, query, r6, s6, stack
from .fourier import SP, spectrum

VOLUME = (8, 8, 8)


def _poses(spark, sf_dir):
    i = F.col("image_id")
    matrix = G.about(G.rotation_2d(i % 12 * (2 * math.pi / 12)), [4.0, 4.0], [(i % 3 - 1) * 0.5, (i % 5) * 0.25])
    return stack(spark, sf_dir).select("image_id", i.alias("out_id"), G.flattened(matrix).alias("matrix"))


T2 = (
    PX
    + """, g as (
  select image_id, y, x, 4 + c * (y - 4) + s * (x - 4) + (image_id % 3 - 1) * 0.5 as cy, 4 - s * (y - 4) + c * (x - 4) + (image_id % 5) * 0.25 as cx
  from (select *, cos(image_id % 12 * (2 * pi() / 12)) as c, sin(image_id % 12 * (2 * pi() / 12)) as s from px)
)"""
)


def linear(target: str, source: str, keys: str, axes: str = "yx", extra: str = "", sparse: bool = False) -> str:
    """SELECT of keys and the linear interpolation v of px-like source at (c<axis>), 0 outside."""
    taps = " ".join(f"cross join range(2) as t{a}(d{a})" for a in axes)
    weight = " * ".join(f"(case when d{a} = 0 then 1 - (c{a} - floor(c{a})) else c{a} - floor(c{a}) end)" for a in axes)
    on = " and ".join(f"p.{a} = floor(g.c{a}) + d{a}" for a in axes)
    if sparse:  # what is read with a share of nothing makes no row
        return f"select {keys}, sum(p.v * {weight}) as v from {target} g {taps} join {source} p on p.image_id = g.image_id and {on}{extra} where {weight} >= 1e-9 group by {keys}"
    return f"select {keys}, sum(coalesce(p.v * {weight}, 0)) as v from {target} g {taps} left join {source} p on p.image_id = g.image_id and {on}{extra} group by {keys}"


@query(T2 + f" select image_id, y, x, {s6('v')} as v from ({linear('g', 'px', 'g.image_id, g.y, g.x')})")
def transform_2d(spark, sf_dir):
    out = G.transform_2d(pixels(spark, sf_dir), _poses(spark, sf_dir), SHAPE)
    return out.select(F.col("out_id").alias("image_id"), "y", "x", r6("v").alias("v"))


def _cubic(f: str, k: str) -> str:
    t = f"abs({f} - {k})"
    return f"(case when {t} <= 1 then (1.5 * {t} - 2.5) * {t} * {t} + 1 when {t} < 2 then ((-0.5 * {t} + 2.5) * {t} - 4) * {t} + 2 else 0 end)"


def _reflect(i: str) -> str:
    return f"case when abs({i}) % 14 >= 8 then 14 - abs({i}) % 14 else abs({i}) % 14 end"


@query(
    T2
    + f""", w as (select g.*, cast(floor(cy) as bigint) as iy, cast(floor(cx) as bigint) as ix, cy - floor(cy) as f, cx - floor(cx) as h from g)
select w.image_id, w.y, w.x, {s6(f"sum(p.v * {_cubic('f', 'dy')} * {_cubic('h', 'dx')})")} as v
from w cross join range(-1, 3) as r(dy) cross join range(-1, 3) as t(dx) join px p on p.image_id = w.image_id and p.y = {_reflect('(iy + dy)')} and p.x = {_reflect('(ix + dx)')} group by w.image_id, w.y, w.x"""
)
def transform_2d_cubic(spark, sf_dir):
    posed = stack(spark, sf_dir).join(_poses(spark, sf_dir).select("image_id", "matrix"), "image_id")
    return stack_to_pixels(G.transform_2d_dense(posed, "cubic", "reflect").drop("matrix")).select("image_id", "y", "x", r6("v").alias("v"))


VOL = PX + ", vol as (select image_id // 8 as image_id, image_id % 8 as z, y, x, v from px)"


def volumes(spark, sf_dir):
    """Eight consecutive images as the planes of a volume."""
    return pixels(spark, sf_dir).select(F.floor(F.col("image_id") / 8).alias("image_id"), (F.col("image_id") % 8).alias("z"), "y", "x", "v")


@query(
    VOL
    + """, g as (
  select image_id, z, y, x, 4 + cb * (z - 4) - sb * (x - 4) as cz, 4 + sa * sb * (z - 4) + ca * (y - 4) + sa * cb * (x - 4) as cy, 4 + ca * sb * (z - 4) - sa * (y - 4) + ca * cb * (x - 4) + 0.25 as cx
  from (select distinct image_id, cos(image_id * 0.3) as ca, sin(image_id * 0.3) as sa, cos(image_id * 0.2) as cb, sin(image_id * 0.2) as sb from vol)
  cross join range(8) as r(z) cross join range(8) as s(y) cross join range(8) as t(x)
)"""
    + f" select image_id, z, y, x, {s6('v')} as v from ({linear('g', 'vol', 'g.image_id, g.z, g.y, g.x', 'zyx')})"
)
def transform_3d(spark, sf_dir):
    v = volumes(spark, sf_dir)
    i = F.col("image_id")
    turn = G.euler_matrix((i * 0.3, i * 0.2, F.lit(0.0)))
    poses = v.select("image_id").distinct().select("image_id", i.alias("out_id"), G.flattened(G.about(turn, [4.0] * 3, [F.lit(0.0), F.lit(0.0), F.lit(0.25)])).alias("matrix"))
    return G.transform_3d(v, poses, VOLUME).select(F.col("out_id").alias("image_id"), "z", "y", "x", r6("v").alias("v"))


@query(
    """with a as (select cast(vec_id as bigint) as image_id, vec_id * 0.1 as a, vec_id * 0.05 as b, vec_id * 0.02 as g from embeddings)
select image_id, round(cos(b) * cos(g), 6) + 0.0 as m00, round(cos(b) * sin(g), 6) + 0.0 as m01, round(-sin(b), 6) + 0.0 as m02,
  round(sin(a) * sin(b) * cos(g) - cos(a) * sin(g), 6) + 0.0 as m10, round(sin(a) * sin(b) * sin(g) + cos(a) * cos(g), 6) + 0.0 as m11, round(sin(a) * cos(b), 6) + 0.0 as m12 from a"""
)
def pose_matrices(spark, sf_dir):
    i = F.col("image_id")
    m = G.euler_matrix((i * 0.1, i * 0.05, i * 0.02))
    return stack(spark, sf_dir).select("image_id", *[r6(m[r][c]).alias(f"m{r}{c}") for r in (0, 1) for c in range(3)])


@query(
    """with a as (select cast(vec_id as bigint) as image_id, vec_id % 12 * 0.5 as a, 1 + vec_id % 3 * 0.25 as s, 0.5 * (vec_id % 5) as t from embeddings),
m as (select *, s * cos(a) as m00, s * sin(a) as m01, -2 * sin(a) as m10, 2 * cos(a) as m11 from a)
select image_id, round(m00, 6) + 0.0 as m00, round(m01, 6) + 0.0 as m01, round(m00 * t - m01 * 1.5 + 3, 6) + 0.0 as m02, round(m10, 6) + 0.0 as m10, round(m11, 6) + 0.0 as m11,
  round(m10 * t - m11 * 1.5 - 1, 6) + 0.0 as m12 from m"""
)
def pose_composition(spark, sf_dir):
    """Translate, rotate, scale, translate again."""
    i = F.col("image_id")
    first = G.translation([0.5 * (i % 5), F.lit(-1.5)])
    m = G.composed(G.translation([F.lit(3.0), F.lit(-1.0)]), G.affine(G.scaling([1 + i % 3 * 0.25, F.lit(2.0)])), G.affine(G.rotation_2d(i % 12 * 0.5)), first)
    return stack(spark, sf_dir).select("image_id", *[r6(m[r][c]).alias(f"m{r}{c}") for r in (0, 1) for c in range(3)])


POLAR = (
    PX
    + """, g as (
  select image_id, y, x, 3.5 + x * 0.5 * sin(y * (2 * pi() / 12)) as cy, 3.5 + x * 0.5 * cos(y * (2 * pi() / 12)) as cx
  from (select distinct image_id from px) cross join range(12) as r(y) cross join range(6) as t(x)
), pol as ("""
    + linear("g", "px", "g.image_id, g.y, g.x")
    + ")"
)


@query(POLAR + f" select image_id, y, x, {s6('v')} as v from pol")
def cartesian2polar(spark, sf_dir):
    out = G.cartesian2polar(pixels(spark, sf_dir), stack(spark, sf_dir), SHAPE, (12, 6), (3.5, 3.5), (0.0, 3.0))
    return out.select(F.col("out_id").alias("image_id"), "y", "x", r6("v").alias("v"))


@query(
    PX
    + """, g as (
  select image_id, y, x, 3.5 + (0.5 + x * 0.5) * sin(0.3 + y * 0.2) as cy, 3.5 + (0.5 + x * 0.5) * cos(0.3 + y * 0.2) as cx
  from (select distinct image_id from px) cross join range(7) as r(y) cross join range(5) as t(x)
), pol as ("""
    + linear("g", "px", "g.image_id, g.y, g.x")
    + f") select image_id, y, x, {s6('v')} as v from pol"
)
def polar_range(spark, sf_dir):
    """A part of a turn, both ends included."""
    out = G.cartesian2polar(pixels(spark, sf_dir), stack(spark, sf_dir), SHAPE, (7, 5), (3.5, 3.5), (0.5, 2.5), phi=(0.3, 1.5), phi_endpoint=True, rho_endpoint=True)
    return out.select(F.col("out_id").alias("image_id"), "y", "x", r6("v").alias("v"))


@query(
    POLAR
    + """, b as (
  select image_id, y, x, (case when atan2(y - 3.5, x - 3.5) < 0 then atan2(y - 3.5, x - 3.5) + 2 * pi() else atan2(y - 3.5, x - 3.5) end) * (12 / (2 * pi())) as cy,
    sqrt((y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5)) * 2 as cx from px
)"""
    + f" select image_id, y, x, {s6('v')} as v from ({linear('b', 'pol', 'g.image_id, g.y, g.x')})"
)
def polar2cartesian(spark, sf_dir):
    polar = G.cartesian2polar(pixels(spark, sf_dir), stack(spark, sf_dir), SHAPE, (12, 6), (3.5, 3.5), (0.0, 3.0))
    polar = polar.select(F.col("out_id").alias("image_id"), F.lit(0).cast("long").alias("z"), "y", "x", "v")
    out = G.polar2cartesian(polar, stack(spark, sf_dir), SHAPE, (12, 6), (3.5, 3.5), (0.0, 3.0))
    return out.select(F.col("out_id").alias("image_id"), "y", "x", r6("v").alias("v"))


@query(
    PX
    + """, g as (
  select image_id, y, x, 3.5 + cos(k * (2 * pi() / 3)) * (y - 3.5) + sin(k * (2 * pi() / 3)) * (x - 3.5) as cy, 3.5 - sin(k * (2 * pi() / 3)) * (y - 3.5) + cos(k * (2 * pi() / 3)) * (x - 3.5) as cx
  from px cross join range(3) as r(k)
)"""
    + f" select image_id, y, x, {s6('v / 3')} as v from ({linear('g', 'px', 'g.image_id, g.y, g.x')})"
)
def symmetrize_2d(spark, sf_dir):
    out = G.symmetrize(pixels(spark, sf_dir), stack(spark, sf_dir), SHAPE, "C3", (3.5, 3.5))
    return out.select(F.col("out_id").alias("image_id"), "y", "x", r6("v").alias("v"))


def spectral(target: str, source: str, keys: str, axes: str = "yx", weight: str = "1.0") -> str:
    """SELECT of keys and re, im: half spectra of width 8 read linearly at frequencies (f<axis>), mirrored where fx < 0 by more
    than rounding."""
    sign = "(case when g.fx <= -1e-9 then -1 else 1 end)"
    taps = " ".join(f"cross join range(2) as t{a}(d{a})" for a in axes)
    c = {a: f"(g.f{a} * {sign})" for a in axes}
    w = " * ".join([weight, *[f"(case when d{a} = 0 then 1 - ({c[a]} - floor({c[a]})) else {c[a]} - floor({c[a]}) end)" for a in axes]])
    on = " and ".join(f"p.k{a} = floor({c[a]}) + d{a}" for a in axes)
    return f"select {keys}, sum(p.re * {w}) as re, sum(p.im * {sign} * {w}) as im from {target} g {taps} join {source} p on p.image_id = g.image_id and {on} group by {keys}"


@query(
    SP
    + """, g as (
  select image_id, ky, kx, (c * ky / 8 + s * kx / 8) * 8 as fy, (-s * ky / 8 + c * kx / 8) * 8 as fx
  from (select fq.*, cos(image_id % 7 * 0.3) as c, sin(image_id % 7 * 0.3) as s from fq where f <= 0.4)
), r as ("""
    + spectral("g", "sp", "g.image_id, g.ky, g.kx")
    + f"""), q as (select *, -2 * pi() * ((image_id % 3 - 1) * ky / 8 + 0.5 * kx / 8) as a from r)
select image_id, ky, kx, {s6('re * cos(a) - im * sin(a)')} as re, {s6('re * sin(a) + im * cos(a)')} as im from q"""
)
def transform_spectrum_2d(spark, sf_dir):
    i = F.col("image_id")
    poses = stack(spark, sf_dir).select("image_id", i.alias("out_id"), G.flattened(G.rotation_2d(i % 7 * 0.3)).alias("matrix"), (i % 3 - 1.0).alias("sy"), F.lit(0.5).alias("sx"))
    out = G.transform_spectrum_2d(spectrum(spark, sf_dir), poses, SHAPE, 0.4)
    return out.select(F.col("out_id").alias("image_id"), "ky", "kx", r6("re").alias("re"), r6("im").alias("im"))


@query(
    SP
    + """, g as (
  select image_id, y, x, x * 0.1 * sin((y + 0.0) * (pi() / 6)) * 8 as fy, x * 0.1 * cos((y + 0.0) * (pi() / 6)) * 8 as fx
  from (select distinct image_id from sp) cross join range(6) as r(y) cross join range(5) as t(x)
), r as ("""
    + spectral("g", "sp", "g.image_id, g.y, g.x")
    + f") select image_id, y, x, {s6('re')} as re, {s6('im')} as im from r"
)
def spectrum2polar(spark, sf_dir):
    out = G.spectrum2polar(spectrum(spark, sf_dir), stack(spark, sf_dir), SHAPE, (6, 5), (0.0, 0.4))
    return out.select(F.col("out_id").alias("image_id"), "y", "x", r6("re").alias("re"), r6("im").alias("im"))


@query()
def spectrum2polar_all(spark, sf_dir):
    """All angles; the tests compare with brute force."""
    out = G.spectrum2polar(spectrum(spark, sf_dir), stack(spark, sf_dir), SHAPE, (6, 5), (0.0, 0.4))
    return out.select(F.col("out_id").alias("image_id"), "y", "x", r6("re").alias("re"), r6("im").alias("im"))


def spectral_cubic(target: str, source: str, keys: str) -> str:
    """The same with the cubic kernel, whose taps are mirrored one by one."""
    return f"""select {keys}, sum(p.re * g.w) as re, sum(p.im * g.w * g.side) as im
from (select *, case when jx < 0 then -1 else 1 end as side from (
  select t.*, floor(fy) + dy as jy, floor(fx) + dx as jx, {_cubic('(fy - floor(fy))', 'dy')} * {_cubic('(fx - floor(fx))', 'dx')} as w
  from {target} t cross join range(-1, 3) as r(dy) cross join range(-1, 3) as u(dx)
)) g join {source} p on p.image_id = g.image_id and p.ky = g.jy * g.side and p.kx = g.jx * g.side group by {keys}"""


@query(
    SP
    + """, g as (
  select image_id, ky, kx, (c * ky / 8 + s * kx / 8) * 8 as fy, (-s * ky / 8 + c * kx / 8) * 8 as fx
  from (select fq.*, cos(image_id % 7 * 0.3 + 0.2) as c, sin(image_id % 7 * 0.3 + 0.2) as s from fq where f <= 0.4)
), r as ("""
    + spectral_cubic("g", "sp", "g.image_id, g.ky, g.kx")
    + f"""), q as (select *, -2 * pi() * ((image_id % 3 - 1) * ky / 8 + 0.5 * kx / 8) as a from r)
select image_id, ky, kx, {s6('re * cos(a) - im * sin(a)')} as re, {s6('re * sin(a) + im * cos(a)')} as im from q"""
)
def transform_spectrum_2d_cubic(spark, sf_dir):
    i = F.col("image_id")
    poses = stack(spark, sf_dir).select("image_id", i.alias("out_id"), G.flattened(G.rotation_2d(i % 7 * 0.3 + 0.2)).alias("matrix"), (i % 3 - 1.0).alias("sy"), F.lit(0.5).alias("sx"))
    out = G.transform_spectrum_2d(spectrum(spark, sf_dir), poses, SHAPE, 0.4, "cubic")
    return out.select(F.col("out_id").alias("image_id"), "ky", "kx", r6("re").alias("re"), r6("im").alias("im"))


@query(
    SP
    + """, g as (
  select image_id, y, x, (0.01 + x * 0.0975) * sin(0.1 + y * (pi() / 6)) * 8 as fy, (0.01 + x * 0.0975) * cos(0.1 + y * (pi() / 6)) * 8 as fx
  from (select distinct image_id from sp) cross join range(6) as r(y) cross join range(5) as t(x)
), r as ("""
    + spectral_cubic("g", "sp", "g.image_id, g.y, g.x")
    + f") select image_id, y, x, {s6('re')} as re, {s6('im')} as im from r"
)
def spectrum2polar_cubic(spark, sf_dir):
    out = G.spectrum2polar(spectrum(spark, sf_dir), stack(spark, sf_dir), SHAPE, (6, 5), (0.01, 0.4), (0.1, 0.1 + math.pi), kernel="cubic")
    return out.select(F.col("out_id").alias("image_id"), "y", "x", r6("re").alias("re"), r6("im").alias("im"))


def _line_filter(source: str, into: str, line: str, i: str) -> str:
    p = "(sqrt(3.0::double) - 2)"
    return f"""{into}_f as (select *, min_by(v, {i}) over (partition by image_id, {line}) as v0 from {source}),
{into}_i as (select image_id, {line}, 6 * (max(v0) + sum(v * (power({p}, {i} + 1) + power({p}, 16 - {i}))) / (1 - power({p}, 16))) as first from {into}_f group by image_id, {line}),
{into}_c as (select a.image_id, a.{line}, a.{i}, max(power({p}, a.{i}) * first) + coalesce(sum(case when b.{i} > 0 then 6 * b.v * power({p}, a.{i} - b.{i}) end), 0) as v
  from {into}_f a join {into}_i using (image_id, {line}) join {into}_f b on b.image_id = a.image_id and b.{line} = a.{line} and b.{i} <= a.{i} group by 1, 2, 3),
{into}_l as (select image_id, {line}, v * {p} / ({p} - 1) as last from {into}_c where {i} = 7),
{into} as (select a.image_id, a.{line}, a.{i}, max(power({p}, 7 - a.{i}) * last) - coalesce(sum(case when b.{i} < 7 then power({p}, b.{i} - a.{i} + 1) * b.v end), 0) as v
  from {into}_c a join {into}_l using (image_id, {line}) join {into}_c b on b.image_id = a.image_id and b.{line} = a.{line} and b.{i} >= a.{i} group by 1, 2, 3)"""


PREFILTER_SQL = PX + ", " + _line_filter("px", "fy", "x", "y") + ", " + _line_filter("fy", "fx", "y", "x") + f" select image_id, y, x, {s6('v')} as v from fx"


@query(PREFILTER_SQL)
def cubic_bspline_prefilter(spark, sf_dir):
    return stack_to_pixels(G.cubic_bspline_prefilter(stack(spark, sf_dir))).select("image_id", "y", "x", r6("v").alias("v"))


@query(PREFILTER_SQL)
def cubic_bspline_prefilter_pixels(spark, sf_dir):
    """The form for images that fit no row."""
    return G.cubic_bspline_prefilter_pixels(pixels(spark, sf_dir), SHAPE).select("image_id", "y", "x", r6("v").alias("v"))


# --- projection ------------------------------------------------------------------------------------------------------


def _turn():
    i = F.col("image_id")
    return G.euler_matrix((i % 4 * 0.5, i % 8 * 0.3, F.lit(0.0)))


def _transposed(m):
    return [[m[j][i] for j in range(len(m))] for i in range(len(m[0]))]


def _pose(spark, sf_dir, matrix):
    return stack(spark, sf_dir).select("image_id", F.floor(F.col("image_id") / 8).alias("volume_id"), G.flattened(matrix).alias("matrix"))


ROT = """, rot as (
  select image_id, image_id // 8 as volume_id, cos(b) as m00, 0.0 as m01, -sin(b) as m02, sin(a) * sin(b) as m10, cos(a) as m11, sin(a) * cos(b) as m12,
    cos(a) * sin(b) as m20, -sin(a) as m21, cos(a) * cos(b) as m22
  from (select cast(vec_id as bigint) as image_id, vec_id % 4 * 0.5 as a, vec_id % 8 * 0.3 as b from embeddings)
)"""


@query(
    PX
    + ROT
    + """, g as (
  select image_id, volume_id, z, y, x, 4 + m10 * (z - 4) + m11 * (y - 4) + m12 * (x - 4) as cy, 4 + m20 * (z - 4) + m21 * (y - 4) + m22 * (x - 4) as cx
  from rot cross join range(8) as r(z) cross join range(8) as s(y) cross join range(8) as t(x)
), o as ("""
    + linear("g", "px", "g.volume_id, g.z, g.y, g.x", sparse=True)
    + f") select volume_id, z, y, x, {s6('v')} as v from o"
)
def backward_project_3d(spark, sf_dir):
    matrix = G.about(_turn(), [4.0] * 3, [F.lit(0.0)] * 3)[1:]
    out = J.backward_project_3d(pixels(spark, sf_dir), _pose(spark, sf_dir, matrix), SHAPE, VOLUME)
    return out.select("volume_id", "z", "y", "x", r6("v").alias("v"))


@query(
    VOL
    + ROT
    + """, q as (
  select image_id as out_id, volume_id as image_id, y, x, w, m00 as a0, m10 as a1, m20 as a2, 4 + m00 * (-4) + m01 * (y - 4) + m02 * (x - 4) as p0,
    4 + m10 * (-4) + m11 * (y - 4) + m12 * (x - 4) as p1, 4 + m20 * (-4) + m21 * (y - 4) + m22 * (x - 4) as p2
  from rot cross join range(8) as r(y) cross join range(8) as s(x) cross join range(-7, 8) as t(w)
), d as (
  select *, case when abs(a0) > 0 then abs(4 / a0) else 'inf'::double end as d0, case when abs(a1) > 0 then abs(4 / a1) else 'inf'::double end as d1, case when abs(a2) > 0 then abs(4 / a2) else 'inf'::double end as d2 from q
), e as (
  select *, w + case when d0 <= d1 and d0 <= d2 then (4 - p0) / a0 when d1 <= d2 then (4 - p1) / a1 else (4 - p2) / a2 end as s from d
), g as (
  select out_id, image_id, y, x, w, p0 + a0 * s as cz, p1 + a1 * s as cy, p2 + a2 * s as cx from e
), o as ("""
    + linear("g", "vol", "g.out_id, g.y, g.x", "zyx", sparse=True)
    + f") select out_id as image_id, y, x, {s6('v')} as v from o"
)
def forward_project_3d(spark, sf_dir):
    matrix = G.about(_turn(), [4.0] * 3, [F.lit(0.0)] * 3)
    out = J.forward_project_3d(volumes(spark, sf_dir), _pose(spark, sf_dir, matrix), SHAPE, VOLUME, 15)
    return out.select("image_id", "y", "x", r6("v").alias("v"))


@query(ORACLE_SQL["forward_project_3d"])
def forward_project_3d_joined(spark, sf_dir):
    """The same for volumes too large to send."""
    matrix = G.about(_turn(), [4.0] * 3, [F.lit(0.0)] * 3)
    out = J.forward_project_3d(volumes(spark, sf_dir), _pose(spark, sf_dir, matrix), SHAPE, VOLUME, 15, most_sent=0)
    return out.select("image_id", "y", "x", r6("v").alias("v"))


#: A magnification by image, an Ewald sphere of unequal radii: sy, sx and the height of a slice at (fy, fx), in SQL.
SY, SX = "((1.0 + image_id % 3 * 0.02) * fy + 0.02 * fx)", "(0.97 * fx)"
RADIUS = (2.5, 2.0)


def _bent(y: str, x: str) -> str:
    return f"({y} * {y} / 5.0 + {x} * {x} / 4.0)"


def _raster_sql(sy: str = "fy", sx: str = "fx", height: str = "0.0", size: int = 8, own: str = "1.0") -> str:
    return f"""{SP}{ROT}, f3 as (
  select volume_id, {own} as own, re, im, m00 * {height} + m01 * {sy} + m02 * {sx} as fz, m10 * {height} + m11 * {sy} + m12 * {sx} as gy, m20 * {height} + m21 * {sy} + m22 * {sx} as gx from fq join rot using (image_id)
), k3 as (
  select *, case when gx < 0 then -1 else 1 end as sg from f3 where fz * fz + gy * gy + gx * gx <= 0.45 * 0.45
), b3 as (
  select volume_id, own, re, im * sg as im, fz * sg * {size} as z, gy * sg * {size} as y, gx * sg * {size} as x from k3
), c3 as (
  select *, cast(floor(z) as bigint) as bz, cast(floor(y) as bigint) as byy, cast(floor(x) as bigint) as bx from b3
), t3 as (
  select volume_id, own, re, im, bz + dz as kz, byy + dy as ky, bx + dx as kx, bx, dx,
    (case when dz = 0 then 1 - (z - bz) else z - bz end) * (case when dy = 0 then 1 - (y - byy) else y - byy end) * (case when dx = 0 then 1 - (x - bx) else x - bx end) as share
  from c3 cross join range(2) as r(dz) cross join range(2) as s(dy) cross join range(2) as t(dx)
), u3 as (
  select volume_id, own, kz, ky, kx, re, im, share from t3 union all select volume_id, own, -kz, -ky, kx, re, -im, share from t3 where bx = 0 and dx = 0
), raster as (
  select volume_id, kz, ky, kx, sum(re * own * share) as re, sum(im * own * share) as im, sum(own * share) as weight from u3
  where share >= 1e-9 and kz between -4 and 3 and ky between -4 and 3 and kx between 0 and 4 group by 1, 2, 3, 4
)"""


RASTER = _raster_sql()
VX = f"{s6('re')} as re, {s6('im')} as im, {s6('weight')} as weight"


def _raster(spark, sf_dir):
    return J.rasterize_central_slices_3d(spectrum(spark, sf_dir), _pose(spark, sf_dir, _turn()), SHAPE, VOLUME, 0.45)


def _vx(df, *keys):
    return df.select(*keys, r6("re").alias("re"), r6("im").alias("im"), r6("weight").alias("weight"))


@query(RASTER + f" select volume_id, kz, ky, kx, {VX} from raster")
def rasterize_central_slices_3d(spark, sf_dir):
    return _vx(_raster(spark, sf_dir), "volume_id", "kz", "ky", "kx")


@query(_raster_sql(own="(1.0 + image_id % 3 * 0.5)") + f" select volume_id, kz, ky, kx, {VX} from raster")
def rasterize_weighted_slices(spark, sf_dir):
    poses = _pose(spark, sf_dir, _turn()).withColumn("weight", 1.0 + F.col("image_id") % 3 * 0.5)
    return _vx(J.rasterize_central_slices_3d(spectrum(spark, sf_dir), poses, SHAPE, VOLUME, 0.45), "volume_id", "kz", "ky", "kx")


def _magnified(spark, sf_dir, matrix):
    i = F.col("image_id")
    return _pose(spark, sf_dir, matrix).withColumn("scaling", F.array(1.0 + i % 3 * 0.02, F.lit(0.02), F.lit(0.0), F.lit(0.97)))


@query(_raster_sql(SY, SX, _bent(SY, SX), 10) + f" select volume_id, kz, ky, kx, {VX} from raster")
def rasterize_magnified_slices(spark, sf_dir):
    """Magnified slices on the Ewald sphere, spread as for a grid of 10."""
    out = J.rasterize_central_slices_3d(spectrum(spark, sf_dir), _magnified(spark, sf_dir, _turn()), SHAPE, VOLUME, 0.45, RADIUS, (10, 10, 10))
    return _vx(out, "volume_id", "kz", "ky", "kx")


def _windowed(h: str, sinc: float, blackman: float, size: int = 8) -> str:
    """A windowed sinc of h, at least one sample of size wide."""
    a, b = f"greatest({sinc}, 1.0 / {size})", f"greatest({blackman}, 1.0 / {size})"
    return f"((case when {h} = 0 then 1 else sin(pi() * {h} / {a}) / (pi() * {h} / {a}) end) * (0.42 + 0.5 * cos(pi() * {h} / {b}) + 0.08 * cos(2 * pi() * {h} / {b})))"


def _near(points: str, keys: str, sy: str = "fy", sx: str = "fx", height: str = "0.0", window: str = "1.0", size: int = 8) -> str:
    return f""", h as (
  select p.*, rot.image_id, m00 * gz + m10 * gy + m20 * gx as fz, m01 * gz + m11 * gy + m21 * gx as fy, m02 * gz + m12 * gy + m22 * gx as fx from {points} p join rot using (volume_id)
), n as (
  select * exclude (fz, fy, fx), fz - {height} as hz, {sy} * 8 as fy, {sx} * 8 as fx from h
), g as (select *, {_windowed('hz', 0.12, 0.2, size)} * {window} as w from n where abs(hz) <= 0.2), s as ({spectral('g', 'sp', keys, weight='g.w')}), q as (select {keys}, sum(w) as weight from g group by {keys})"""


@query(
    SP
    + ROT
    + """, pts as (
  select volume_id, kz, ky, kx, kz / 8.0 as gz, ky / 8.0 as gy, kx / 8.0 as gx from (select distinct volume_id from rot) cross join range(-4, 4) as r(kz) cross join range(-4, 4) as s(ky) cross join range(5) as t(kx)
  where (kz * kz + ky * ky + kx * kx) / 64.0 <= 0.4 * 0.4
)"""
    + _near("pts", "g.volume_id, g.kz, g.ky, g.kx")
    + f" select volume_id, kz, ky, kx, {s6('coalesce(re, 0)')} as re, {s6('coalesce(im, 0)')} as im, {s6('weight')} as weight from q left join s using (volume_id, kz, ky, kx)"
)
def insert_central_slices_3d(spark, sf_dir):
    out = J.insert_central_slices_3d(spectrum(spark, sf_dir), _pose(spark, sf_dir, _transposed(_turn())), SHAPE, VOLUME, 0.12, 0.2, 0.4)
    return _vx(out, "volume_id", "kz", "ky", "kx")


@query(
    SP
    + ROT
    + """, pts as (
  select volume_id, kz, ky, kx, kz / 10.0 as gz, ky / 10.0 as gy, kx / 10.0 as gx from (select distinct volume_id from rot) cross join range(-4, 4) as r(kz) cross join range(-4, 4) as s(ky) cross join range(5) as t(kx)
  where (kz * kz + ky * ky + kx * kx) / 100.0 <= 0.41 * 0.41
)"""
    + _near("pts", "g.volume_id, g.kz, g.ky, g.kx", SY, SX, _bent("fy", "fx"), size=10)
    + f" select volume_id, kz, ky, kx, {s6('coalesce(re, 0)')} as re, {s6('coalesce(im, 0)')} as im, {s6('weight')} as weight from q left join s using (volume_id, kz, ky, kx)"
)
def insert_magnified_slices(spark, sf_dir):
    poses = _magnified(spark, sf_dir, _transposed(_turn()))
    out = J.insert_central_slices_3d(spectrum(spark, sf_dir), poses, SHAPE, VOLUME, 0.12, 0.2, 0.41, RADIUS, (10, 10, 10))
    return _vx(out, "volume_id", "kz", "ky", "kx")


OUT = """, pts as (
  select o.image_id as out_id, volume_id, ky, kx, m01 * ky / 8.0 + m02 * kx / 8.0 as gz, m11 * ky / 8.0 + m12 * kx / 8.0 as gy, m21 * ky / 8.0 + m22 * kx / 8.0 as gx
  from rot o cross join range(-4, 4) as s(ky) cross join range(5) as t(kx) where (ky * ky + kx * kx) / 64.0 <= 0.41 * 0.41
)"""


@query(
    SP
    + ROT
    + """, v3 as (
  select image_id, kz, ky, kx, sum(v * cos(a)) / 512 as re, sum(v * sin(a)) / 512 as im
  from (select image_id // 8 as image_id, kz, ky, kx, v, -2 * pi() * (kz * (image_id % 8) + ky * y + kx * x) / 8 as a from px, range(-4, 4) as d(kz), range(-4, 4) as f(ky), range(0, 5) as g(kx))
  group by image_id, kz, ky, kx
)"""
    + OUT
    + ", g as (select volume_id as image_id, out_id, ky, kx, gz * 8 as fz, gy * 8 as fy, gx * 8 as fx from pts), r as ("
    + spectral("g", "v3", "g.out_id, g.ky, g.kx", "zyx")
    + f") select out_id, ky, kx, {s6('re')} as re, {s6('im')} as im from r"
)
def extract_central_slices_3d(spark, sf_dir):
    whole = pixels_to_stack(volumes(spark, sf_dir), VOLUME)
    spectra = T.to_frequencies(T.fft_r2c(whole), VOLUME)
    out = J.extract_central_slices_3d(spectra, _pose(spark, sf_dir, _turn()), SHAPE, VOLUME, 0.41)
    return out.select("out_id", "ky", "kx", r6("re").alias("re"), r6("im").alias("im"))


@query(
    SP
    + ROT
    + OUT
    + _near("pts", "g.out_id, g.ky, g.kx")
    + f" select out_id, ky, kx, {s6('coalesce(re, 0) / greatest(1, abs(weight))')} as re, {s6('coalesce(im, 0) / greatest(1, abs(weight))')} as im, {s6('weight')} as weight from q left join s using (out_id, ky, kx)"
)
def insert_and_extract_central_slices_3d(spark, sf_dir):
    poses = _pose(spark, sf_dir, _turn())
    out = J.insert_and_extract_central_slices_3d(spectrum(spark, sf_dir), _pose(spark, sf_dir, _transposed(_turn())), poses, SHAPE, 0.12, 0.2, 0.41, correct_weights=True)
    return _vx(out, "out_id", "ky", "kx")


BENT_OUT = f""", o as (
  select out_id, volume_id, ky, kx, m00 * hz + m01 * sy + m02 * sx as oz, m10 * hz + m11 * sy + m12 * sx as gy, m20 * hz + m21 * sy + m22 * sx as gx
  from (select *, {_bent('sy', 'sx')} as hz from (
    select *, image_id as out_id, {SY} as sy, {SX} as sx from (select *, ky / 8.0 as fy, kx / 8.0 as fx from rot cross join range(-4, 4) as s(ky) cross join range(5) as t(kx))))
), pts as (
  select out_id, volume_id, ky, kx, oz + st / 8.0 as gz, gy, gx, {_windowed('(st / 8.0)', 0.15, 0.3)} as along from o cross join range(-2, 3) as w(st)
  where (oz + st / 8.0) * (oz + st / 8.0) + gy * gy + gx * gx <= 0.41 * 0.41
)"""


@query(
    SP
    + ROT
    + """, v3 as (
  select image_id, kz, ky, kx, sum(v * cos(a)) / 512 as re, sum(v * sin(a)) / 512 as im
  from (select image_id // 8 as image_id, kz, ky, kx, v, -2 * pi() * (kz * (image_id % 8) + ky * y + kx * x) / 8 as a from px, range(-4, 4) as d(kz), range(-4, 4) as f(ky), range(0, 5) as g(kx))
  group by image_id, kz, ky, kx
)"""
    + BENT_OUT
    + ", g as (select volume_id as image_id, out_id, ky, kx, along as w, gz * 8 as fz, gy * 8 as fy, gx * 8 as fx from pts), s as ("
    + spectral("g", "v3", "g.out_id, g.ky, g.kx", "zyx", "g.w")
    + "), q as (select out_id, ky, kx, sum(w) as weight from g group by out_id, ky, kx)"
    + f" select out_id, ky, kx, {s6('coalesce(re, 0)')} as re, {s6('coalesce(im, 0)')} as im, {s6('weight')} as weight from q left join s using (out_id, ky, kx)"
)
def extract_windowed_slices(spark, sf_dir):
    """Magnified slices on the Ewald sphere, summed along the depth under a windowed sinc."""
    whole = pixels_to_stack(volumes(spark, sf_dir), VOLUME)
    spectra = T.to_frequencies(T.fft_r2c(whole), VOLUME)
    out = J.extract_central_slices_3d(spectra, _magnified(spark, sf_dir, _turn()), SHAPE, VOLUME, 0.41, RADIUS, sinc=0.15, blackman=0.3)
    return _vx(out, "out_id", "ky", "kx")


@query(
    SP
    + ROT
    + BENT_OUT
    + _near("pts", "g.out_id, g.ky, g.kx", SY, SX, _bent("fy", "fx"), "along")
    + f" select out_id, ky, kx, {s6('2 * coalesce(re, 0)')} as re, {s6('2 * coalesce(im, 0)')} as im, {s6('2 * weight')} as weight from q left join s using (out_id, ky, kx)"
)
def insert_and_extract_added_slices(spark, sf_dir):
    """The same straight from other slices, added to what an earlier call gave."""
    once = lambda **more: J.insert_and_extract_central_slices_3d(spectrum(spark, sf_dir), _magnified(spark, sf_dir, _transposed(_turn())), _magnified(spark, sf_dir, _turn()), SHAPE, 0.12, 0.2, 0.41, ews_radius=RADIUS, depth_window=(0.15, 0.3), **more)
    return _vx(once(add_to=once()), "out_id", "ky", "kx")


SINC2 = "power(case when r = 0 then 1 else sin(pi() * r) / (pi() * r) end, 2)"


@query(PX + f", q as (select *, sqrt(power((y - 4) / 8.0, 2) + power((x - 4) / 8.0, 2)) as r from px) select image_id, y, x, {s6(f'v / {SINC2}')} as v from q")
def fourier_interpolation_correction(spark, sf_dir):
    return J.fourier_interpolation_correction(pixels(spark, sf_dir), SHAPE).select("image_id", "y", "x", r6("v").alias("v"))


@query(RASTER + f" select volume_id, kz, ky, kx, {s6('re / weight')} as re, {s6('im / weight')} as im from raster")
def weight_correction(spark, sf_dir):
    out = J.weight_corrected(_raster(spark, sf_dir))
    return out.select("volume_id", "kz", "ky", "kx", r6("re").alias("re"), r6("im").alias("im"))
