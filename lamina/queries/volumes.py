"""Queries of the 1-d and 3-d forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import correlation as X
from ..operators import fourier as T
from ..operators import generators as G
from ..operators import geometry as M
from ..operators import neighbourhoods as N
from ..operators import projection as J
from ..operators import reductions as R
from ..operators import spectra as P
from ..operators.reshape import pixels_to_stack, stack_to_pixels
from .base import PX, SHAPE, pixels, query, r6, s6, stack
from .geometry import ROT, VOL, VOLUME, _pose, _turn, linear, spectral, volumes

LINE = (1, 1, 8)
LN = PX + ", ln as (select image_id * 8 + y as image_id, x, v from px)"


def lines(spark, sf_dir):
    """Every row of an image as a 1-d signal."""
    return pixels(spark, sf_dir).select((F.col("image_id") * 8 + F.col("y")).alias("image_id"), F.lit(0).cast("long").alias("z"), F.lit(0).cast("long").alias("y"), "x", "v")


def _line_spectra(spark, sf_dir):
    return T.to_frequencies(T.fft_r2c(pixels_to_stack(lines(spark, sf_dir), LINE)), LINE)


@query(
    LN
    + f""", s as (select image_id, kx, sum(v * cos(-2 * pi() * kx * x / 8)) / 8 as re, sum(v * sin(-2 * pi() * kx * x / 8)) / 8 as im from ln, range(5) as r(kx) group by image_id, kx),
g as (select *, -2 * pi() * (image_id % 5) * 0.3 * kx / 8 as a from s)
select image_id, kx, {s6('re * cos(a) - im * sin(a)')} as re, {s6('re * sin(a) + im * cos(a)')} as im from g"""
)
def phase_shift_1d(spark, sf_dir):
    s = _line_spectra(spark, sf_dir)
    shifts = lines(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(0.0).alias("sz"), F.lit(0.0).alias("sy"), (F.col("image_id") % 5 * 0.3).alias("sx"))
    return P.phase_shift(s, shifts, LINE).select("image_id", "kx", r6("re").alias("re"), r6("im").alias("im"))


def _volume_spectra(spark, sf_dir):
    return T.to_frequencies(T.fft_r2c(pixels_to_stack(volumes(spark, sf_dir), VOLUME)), VOLUME)


# absent planes of the last volume are 0
FULL = VOL + ", fv as (select i.image_id, zz as z, yy as y, xx as x, coalesce(v, 0.0) as v from (select distinct image_id from vol) i cross join range(8) as r(zz) cross join range(8) as s(yy) cross join range(8) as t(xx) left join vol on vol.image_id = i.image_id and z = zz and y = yy and x = xx)"


@query(FULL + f" select image_id, (z + 1) % 8 as z, (y + image_id % 3) % 8 as y, (x + 7) % 8 as x, {s6('v')} as v from fv")
def phase_shift_3d(spark, sf_dir):
    s = _volume_spectra(spark, sf_dir)
    shifts = s.select("image_id").distinct().select("image_id", F.lit(1.0).alias("sz"), (F.col("image_id") % 3).cast("double").alias("sy"), F.lit(-1.0).alias("sx"))
    moved = T.fft_c2r(T.from_frequencies(P.phase_shift(s, shifts, VOLUME), VOLUME))
    return stack_to_pixels(moved).select("image_id", "z", "y", "x", r6("v").alias("v"))


@query(
    FULL
    + f""", m as (select a.image_id, ((a.x - b.x + 8) % 8 + 4) % 8 as x, sum(a.v * b.v) / 8 as v from ln a join ln b on b.image_id = a.image_id + 8 group by 1, 2),
b as (select image_id, arg_max(x, v) as x, max(v) as v from m group by image_id),
n as (select b.*, l.v as l, r.v as r from b join m l on l.image_id = b.image_id and l.x = (b.x + 7) % 8 join m r on r.image_id = b.image_id and r.x = (b.x + 1) % 8),
f as (select *, (l + r - 2 * v) / 2 as a, (r - l) / 2 as c from n)
select image_id, {s6('x - c / (2 * a)')} as x, {s6('v - c * c / (4 * a)')} as value from f where a < -1e-5""".replace("from ln", "from (select image_id * 8 + y as image_id, x, v from px)").replace("join ln", "join (select image_id * 8 + y as image_id, x, v from px)")
)
def cross_correlation_peak_1d(spark, sf_dir):
    maps = _line_maps(spark, sf_dir)
    # peaks so flat that rounding decides are left out of the comparison
    top = maps.groupBy("image_id").agg(F.max_by("x", "v").alias("p"), F.max("v").alias("m"))
    sides = maps.join(top, "image_id").filter((F.col("x") == (F.col("p") + 1) % 8) | (F.col("x") == (F.col("p") + 7) % 8)).groupBy("image_id", "m").agg(F.sum("v").alias("s"))
    curved = sides.filter((F.col("s") - 2 * F.col("m")) / 2 < -1e-5).select("image_id")
    return X.peak(maps, LINE).join(curved, "image_id").select("image_id", r6("x").alias("x"), r6("value").alias("value"))


def _line_maps(spark, sf_dir):
    s = _line_spectra(spark, sf_dir)
    product = X.correlation_spectrum(X.zip_spectra(s, s.withColumn("image_id", F.col("image_id") - 8)))
    return X.centered(stack_to_pixels(T.fft_c2r(T.from_frequencies(product, LINE))), LINE)


@query()
def cross_correlation_peak_1d_all(spark, sf_dir):
    """All lines, those with a flat peak too; the tests compare with brute force."""
    return X.peak(_line_maps(spark, sf_dir), LINE).select("image_id", r6("x").alias("x"), r6("value").alias("value"))


@query(
    FULL
    + f""", m as (
  select a.image_id, ((a.z - b.z + 8) % 8 + 4) % 8 as z, ((a.y - b.y + 8) % 8 + 4) % 8 as y, ((a.x - b.x + 8) % 8 + 4) % 8 as x, sum(a.v * b.v) / 512 as v
  from fv a join fv b on b.image_id = a.image_id + 1 group by 1, 2, 3, 4
) select image_id, cast(arg_max(z, v) as double) as z, cast(arg_max(y, v) as double) as y, cast(arg_max(x, v) as double) as x, {s6('max(v)')} as value from m group by image_id"""
)
def cross_correlation_peak_3d(spark, sf_dir):
    s = _volume_spectra(spark, sf_dir)
    product = X.correlation_spectrum(X.zip_spectra(s, s.withColumn("image_id", F.col("image_id") - 1)))
    maps = X.centered(stack_to_pixels(T.fft_c2r(T.from_frequencies(product, VOLUME))), VOLUME)
    found = X.peak(maps, VOLUME, subpixel=False)
    return found.select("image_id", "z", "y", "x", r6("value").alias("value"))


PEAK_AXIS = """select b.image_id, b.v, sum(p.v) as t, sum({s} * p.v) as t1, sum({s} * {s} * p.v) as t2 from b cross join range(-2, 3) as r(k)
  join px p on p.image_id = b.image_id and {on} group by all"""


@query(
    PX
    + """, b as (select image_id, max(v) as v, arg_max(y, (v, -(y * 8 + x))) as y, arg_max(x, (v, -(y * 8 + x))) as x from px group by image_id),
fy as ("""
    + PEAK_AXIS.format(s="k", on="p.x = b.x and p.y = (b.y + k + 8) % 8")
    + "), fx as ("
    + PEAK_AXIS.format(s="k", on="p.y = b.y and p.x = (b.x + k + 8) % 8")
    + """), f as (
  select 'y' as axis, *, (5 * t2 - 10 * t) / 70 as a, t1 / 10 as c from fy union all select 'x', *, (5 * t2 - 10 * t) / 70, t1 / 10 from fx
), g as (
  select image_id, axis, case when abs(a) >= 1e-6 then -c / (2 * a) else 0 end as o, case when abs(a) >= 1e-6 then (t - 10 * a) / 5 - c * c / (4 * a) else v end as h from f
)"""
    + f" select b.image_id, {s6('b.y + p.o')} as y, {s6('b.x + q.o')} as x, {s6('(p.h + q.h) / 2')} as value from b join g p on p.image_id = b.image_id and p.axis = 'y' join g q on q.image_id = b.image_id and q.axis = 'x'"
)
def peak_radius(spark, sf_dir):
    """The parabola through five values an axis."""
    found = X.peak(pixels(spark, sf_dir).drop("label"), SHAPE, radius=2)
    return found.select("image_id", r6("y").alias("y"), r6("x").alias("x"), r6("value").alias("value"))


@query(
    PX
    + """, g as (
  select image_id, z, y, x, 4 - (y + 1.0 - 3.5) + 3.5 - 4 + 0.5 as py, 4 - (x - 3.5) + 3.5 - 4 as px, y + 1.0 + 0.5 as qy, x + 0.0 as qx from px
), h as (
  select image_id, y, x, qy as cy, qx as cx from g union all select image_id, y, x, py, px from g
)"""
    + f" select image_id, y, x, {s6('v / 2')} as v from ({linear('h', 'px', 'g.image_id, g.y, g.x')})"
)
def symmetrize_moved(spark, sf_dir):
    """C2 between a shift of the output and one of the input."""
    one = lambda y: [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, y], [0.0, 0.0, 1.0, 0.0]]
    out = M.symmetrize(pixels(spark, sf_dir), stack(spark, sf_dir), SHAPE, "C2", (3.5, 3.5), pre=one(0.5), post=one(1.0))
    return out.select(F.col("out_id").alias("image_id"), "y", "x", r6("v").alias("v"))


CUBE = "cross join range(-1, 2) as r(dz) cross join range(-1, 2) as s(dy) cross join range(-1, 2) as t(dx)"


@query(
    FULL
    + f""" select p.image_id, p.z, p.y, p.x, {s6('sum(q.v * (0.1 + 0.01 * dz + 0.02 * dy * dx))')} as v from fv p {CUBE}
join fv q on q.image_id = p.image_id and q.z = p.z + dz and q.y = p.y + dy and q.x = p.x + dx group by 1, 2, 3, 4"""
)
def convolve_3d(spark, sf_dir):
    kernel = [[[0.1 + 0.01 * z + 0.02 * y * x for x in (-1, 0, 1)] for y in (-1, 0, 1)] for z in (-1, 0, 1)]
    whole = stack_to_pixels(pixels_to_stack(volumes(spark, sf_dir), VOLUME))
    return N.convolve(whole, VOLUME, kernel).select("image_id", "z", "y", "x", r6("v").alias("v"))


@query(
    VOL
    + f""" select p.image_id, p.z, p.y, p.x, {s6('median(coalesce(q.v, 0.0))')} as v from vol p {CUBE}
left join vol q on q.image_id = p.image_id and q.z = p.z + dz and q.y = p.y + dy and q.x = p.x + dx group by 1, 2, 3, 4"""
)
def median_filter_3d(spark, sf_dir):
    return N.median_filter(volumes(spark, sf_dir), VOLUME, (3, 3, 3), "zero").select("image_id", "z", "y", "x", r6("v").alias("v"))


@query(
    VOL
    + """, d as (
  select *, sqrt(power(z - 3.5, 2) + power(y - 3.5, 2) + power(x - 4, 2)) as r, sqrt(power((z - 3.5) / 2, 2) + power((y - 3.5) / 3, 2) + power((x - 4) / 1.5, 2)) as q,
    sqrt(power(y - 3.5, 2) + power(x - 4, 2)) - 1.5 as c, abs(z - 3.5) - 2 as l from vol
), e as (
  select *, case when q <= 1 then 1.0 when r - r / q >= 1.2 then 0.0 else 0.5 + 0.5 * cos(pi() * (r - r / q) / 1.2) end as ellipse,
    (case when c <= 0 then 1.0 when c >= 1.2 then 0.0 else 0.5 + 0.5 * cos(pi() * c / 1.2) end) * (case when l <= 0 then 1.0 when l >= 1.2 then 0.0 else 0.5 + 0.5 * cos(pi() * l / 1.2) end) as cylinder
  from d
)"""
    + f" select image_id, z, y, x, {s6('v * ellipse')} as ellipse, {s6('v * cylinder')} as cylinder from e"
)
def draw_mask_3d(spark, sf_dir):
    v = volumes(spark, sf_dir)
    value = {"cz": 3.5, "cy": 3.5, "cx": 4.0, "rz": 2.0, "ry": 3.0, "rx": 1.5, "smoothness": 1.2, "cvalue": 1.0}
    masks = v.select("image_id").distinct().hint("merge").withColumns({**{k: F.lit(x) for k, x in value.items()}, "invert": F.lit(False)})
    drawn = [G.draw_mask(v, masks, s, has_z=True).select("image_id", "z", "y", "x", r6("v").alias(s)) for s in ("ellipse", "cylinder")]
    return drawn[0].join(drawn[1].hint("merge"), ["image_id", "z", "y", "x"])


@query(VOL + f" select p.image_id, p.z, p.y, p.x, {s6('(p.v + q.v) / 2')} as v from vol p join vol q on q.image_id = p.image_id and q.z = p.z and q.y = 7 - p.y and q.x = 7 - p.x")
def symmetrize_3d(spark, sf_dir):
    v = volumes(spark, sf_dir)
    present = v.select("image_id", "z").distinct()
    out = M.symmetrize(v, v.select("image_id").distinct(), VOLUME, "C2", (3.5, 3.5, 3.5)).withColumnRenamed("out_id", "image_id")
    return out.join(present, ["image_id", "z"]).select("image_id", "z", "y", "x", r6("v").alias("v"))


@query(
    PX
    + """, v3 as (
  select image_id, kz, ky, kx, sum(v * cos(a)) / 512 as re, sum(v * sin(a)) / 512 as im
  from (select image_id // 8 as image_id, kz, ky, kx, v, -2 * pi() * (kz * (image_id % 8) + ky * y + kx * x) / 8 as a from px, range(-4, 4) as d(kz), range(-4, 4) as f(ky), range(0, 5) as g(kx))
  group by image_id, kz, ky, kx
), g as (
  select image_id, kz, ky, kx, kz as fz, c * ky + s * kx as fy, -s * ky + c * kx as fx from (select *, cos(image_id % 5 * 0.3) as c, sin(image_id % 5 * 0.3) as s from v3)
  where sqrt((kz / 8.0) * (kz / 8.0) + (ky / 8.0) * (ky / 8.0) + (kx / 8.0) * (kx / 8.0)) <= 0.4
), r as ("""
    + spectral("g", "v3", "g.image_id, g.kz, g.ky, g.kx", "zyx")
    + f"), q as (select *, -2 * pi() * (0.5 * kz - 0.25 * kx) / 8 as a from r) select image_id, kz, ky, kx, {s6('re * cos(a) - im * sin(a)')} as re, {s6('re * sin(a) + im * cos(a)')} as im from q"
)
def transform_spectrum_3d(spark, sf_dir):
    s = _volume_spectra(spark, sf_dir)
    i = F.col("image_id")
    poses = s.select("image_id").distinct().select("image_id", i.alias("out_id"), M.flattened(M.rotation("z", i % 5 * 0.3)).alias("matrix"), F.lit(0.5).alias("sz"), F.lit(0.0).alias("sy"), F.lit(-0.25).alias("sx"))
    out = M.transform_spectrum_3d(s, poses, VOLUME, 0.4)
    return out.select(F.col("out_id").alias("image_id"), "kz", "ky", "kx", r6("re").alias("re"), r6("im").alias("im"))


@query(
    PX
    + ROT
    + """, q as (
  select image_id as out_id, volume_id, y, x, w, m00 as a0, m10 as a1, m20 as a2, 4 + m00 * (-4) + m01 * (y - 4) + m02 * (x - 4) as p0,
    4 + m10 * (-4) + m11 * (y - 4) + m12 * (x - 4) as p1, 4 + m20 * (-4) + m21 * (y - 4) + m22 * (x - 4) as p2
  from rot cross join range(8) as r(y) cross join range(8) as s(x) cross join range(-3, 4) as t(w)
), d as (
  select *, case when abs(a0) > 0 then abs(4 / a0) else 'inf'::double end as d0, case when abs(a1) > 0 then abs(4 / a1) else 'inf'::double end as d1, case when abs(a2) > 0 then abs(4 / a2) else 'inf'::double end as d2 from q
), e as (
  select *, w + case when d0 <= d1 and d0 <= d2 then (4 - p0) / a0 when d1 <= d2 then (4 - p1) / a1 else (4 - p2) / a2 end as s from d
), c as (
  select out_id, volume_id, y, x, p0 + a0 * s as vz, p1 + a1 * s as vy, p2 + a2 * s as vx from e
), h as (
  select *, (case when vz < 0 then 1 + vz when vz > 7 then 8 - vz else 1 end) * (case when vy < 0 then 1 + vy when vy > 7 then 8 - vy else 1 end) * (case when vx < 0 then 1 + vx when vx > 7 then 8 - vx else 1 end) as edge
  from c where vz > -1 and vz < 8 and vy > -1 and vy < 8 and vx > -1 and vx < 8
), g as (
  select rot.image_id, out_id, y, x, edge, 4 + m10 * (vz - 4) + m11 * (vy - 4) + m12 * (vx - 4) as cy, 4 + m20 * (vz - 4) + m21 * (vy - 4) + m22 * (vx - 4) as cx from h join rot using (volume_id)
), o as ("""
    + linear("g", "px", "g.out_id, g.y, g.x", sparse=True).replace("sum(p.v *", "sum(edge * p.v *").replace("where (case", "where edge * (case")
    + f") select out_id as image_id, y, x, {s6('v')} as v from o"
)
def backward_and_forward_project_3d(spark, sf_dir):
    whole = M.about(_turn(), [4.0] * 3, [F.lit(0.0)] * 3)
    out = J.backward_and_forward_project_3d(pixels(spark, sf_dir), _pose(spark, sf_dir, whole[1:]), _pose(spark, sf_dir, whole), SHAPE, VOLUME, 7)
    return out.select("image_id", "y", "x", r6("v").alias("v"))


@query(PX + f" select image_id, x, {s6('sum(v * v * v)')} as value from px group by image_id, x")
def reduce_axes_ewise(spark, sf_dir):
    return R.reduce_axes_ewise(pixels(spark, sf_dir), ["image_id", "x"], CUBES).select("image_id", "x", r6("value").alias("value"))


#: Count, mean and sum of squares about the mean, which don't add up: parts are joined by the parallel formula.
def _moments(state: tuple[float, ...], v: np.ndarray) -> tuple[float, ...]:
    return _moments_joined(state, (float(len(v)), float(v.mean()), float(((v - v.mean()) ** 2).sum())))


def _moments_joined(a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
    n = a[0] + b[0]
    if n == 0:
        return a
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


CUBES = R.Reduction((0.0,), lambda state, v: (state[0] + float((v**3).sum()),), lambda a, b: (a[0] + b[0],), lambda state: state[0])
SPREAD = R.Reduction((0.0, 0.0, 0.0), _moments, _moments_joined, lambda state: (state[2] / state[0]) ** 0.5)


@query(f"select l_returnflag as flag, {s6('stddev_pop(cast(l_extendedprice as double))')} as value from lineitem group by l_returnflag")
def reduce_axes_whole_table(spark, sf_dir):
    """A user's reduction over groups that hold a large part of the table, none of which any task gathers."""
    prices = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("v"))
    return R.reduce_axes_ewise(prices, ["flag"], SPREAD).select("flag", r6("value").alias("value"))


@query(PX + f" select label, y, x, {s6('max(v)')} as max, {s6('min(v)')} as min from px group by label, y, x")
def reduce_min_max(spark, sf_dir):
    return R.reduce(pixels(spark, sf_dir), ["label", "y", "x"], "max", "min").select("label", "y", "x", r6("max").alias("max"), r6("min").alias("min"))


@query("select cast(vec_id as bigint) as image_id, i as place, 0.0::double as zeros, 1.0::double as ones from embeddings, range(6) as r(i)")
def zeros_ones(spark, sf_dir):
    images = stack(spark, sf_dir).select("image_id")
    flat = lambda value, name: G.fill_stack(images, (1, 2, 3), value).select("image_id", F.posexplode("values").alias("p", name)).select("image_id", F.col("p").cast("long").alias("place"), name).hint("merge")
    return flat(0.0, "zeros").join(flat(1.0, "ones"), ["image_id", "place"])
