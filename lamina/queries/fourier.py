"""Queries of transforms, spectrum filters, CTFs, correlation and shells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ctf as C
from ..functions.elementwise import power
from ..operators import correlation as X
from ..operators import fourier as T
from ..operators import shells as H
from ..operators import spectra as P
from ..operators.reshape import stack_to_pixels
from .base import PX, SHAPE, pixels, query, r6, s6, stack

SP = (
    PX
    + """, sp as (
  select image_id, ky, kx, sum(v * cos(a)) / 64 as re, sum(v * sin(a)) / 64 as im
  from (select image_id, ky, kx, v, -2 * pi() * (ky * y + kx * x) / 8 as a from px, range(-4, 4) as f(ky), range(0, 5) as g(kx))
  group by image_id, ky, kx
), fq as (
  select *, ky / 8.0 as fy, kx / 8.0 as fx, sqrt((ky / 8.0) * (ky / 8.0) + (kx / 8.0) * (kx / 8.0)) as f from sp
)"""
)
C6 = f"select image_id, ky, kx, {s6('re')} as re, {s6('im')} as im from "


def spectrum(spark, sf_dir):
    """Half spectra of the images."""
    return T.to_frequencies(T.fft_r2c(stack(spark, sf_dir)), SHAPE)


def _c(df):
    return df.select("image_id", "ky", "kx", r6("re").alias("re"), r6("im").alias("im"))


@query(SP + C6 + "sp")
def fft_r2c(spark, sf_dir):
    return _c(spectrum(spark, sf_dir))


@query(SP + C6 + "sp")
def dft_join(spark, sf_dir):
    return _c(T.dft_join(pixels(spark, sf_dir), SHAPE))


@query(SP + C6 + "sp")
def dft_factored(spark, sf_dir):
    return _c(T.dft_factored(pixels(spark, sf_dir), SHAPE))


@query(PX + f" select image_id, y, x, {s6('v')} as v from px")
def fft_c2r(spark, sf_dir):
    back = T.fft_c2r(T.from_frequencies(spectrum(spark, sf_dir), SHAPE))
    return stack_to_pixels(back).select("image_id", "y", "x", r6("v").alias("v"))


@query(
    PX
    + """, two as (select a.image_id, a.y, a.x, a.v as re, b.v as im from px a join px b on b.image_id = a.image_id + 1 and a.y = b.y and a.x = b.x),
w as (select image_id, ky, kx, re, im, -2 * pi() * (ky * y + kx * x) / 8 as a from two, range(-4, 4) as f(ky), range(-4, 4) as g(kx))
select image_id, ky, kx, round(sum(re * cos(a) - im * sin(a)) / 64, 6) + 0.0 as re, round(sum(re * sin(a) + im * cos(a)) / 64, 6) + 0.0 as im from w group by image_id, ky, kx"""
)
def fft_c2c(spark, sf_dir):
    images = stack(spark, sf_dir)
    after = images.select((F.col("image_id") - 1).alias("image_id"), F.col("values").alias("im"))
    both = images.join(after, "image_id").select("image_id", "d", "h", "w", F.col("values").alias("re"), "im")
    return _c(T.to_frequencies(T.fft_c2c(both), SHAPE, half=False))


@query(
    PX
    + """, w as (select image_id, ky, kx, v, -2 * pi() * (ky * y + kx * x) / 8 as a from px, range(-4, 4) as f(ky), range(-4, 4) as g(kx))
select image_id, ky + 4 as iy, kx + 4 as ix, round(sum(v * cos(a)) / 64, 6) + 0.0 as re, round(sum(v * sin(a)) / 64, 6) + 0.0 as im from w group by image_id, ky, kx"""
)
def fft_remap(spark, sf_dir):
    full = T.remap(spectrum(spark, sf_dir), SHAPE, "h", "fc")
    return full.select("image_id", "iy", "ix", r6("re").alias("re"), r6("im").alias("im"))


@query(
    SP
    + """, k as (select * from sp where ky between -3 and 2 and kx <= 3)
select k.image_id, k.ky, k.kx, round(case when k.kx = 3 then (k.re + m.re) / 2 else k.re end, 6) + 0.0 as re, round(case when k.kx = 3 then (k.im - m.im) / 2 else k.im end, 6) + 0.0 as im
from k join sp m on m.image_id = k.image_id and m.ky = -k.ky and m.kx = k.kx"""
)
def fft_resize(spark, sf_dir):
    return _c(T.fft_resize(spectrum(spark, sf_dir), SHAPE, (1, 6, 6), correct_nyquist=True))


@query(SP + f" select image_id, ky, kx, {s6('re * re + im * im')} as power from sp")
def power_spectrum(spark, sf_dir):
    return spectrum(spark, sf_dir).select("image_id", "ky", "kx", r6(power(F.col("re"), F.col("im"))).alias("power"))


LOW = "case when f <= {c} then 1.0 when f >= {c} + {w} then 0.0 else 0.5 * (1 + cos(pi() * ({c} - f) / {w})) end"
HIGH = "case when f >= {c} then 1.0 when f <= {c} - {w} then 0.0 else 0.5 * (1 + cos(pi() * (f - {c}) / {w})) end"


def _filtered(mask: str) -> str:
    return SP + f", g as (select *, {mask} as m from fq) select image_id, ky, kx, {s6('re * m')} as re, {s6('im * m')} as im from g"


@query(_filtered(LOW.format(c="0.2", w="0.15")))
def lowpass(spark, sf_dir):
    return _c(P.lowpass(spectrum(spark, sf_dir), SHAPE, 0.2, 0.15))


@query(_filtered(HIGH.format(c="0.3", w="0.2")))
def highpass(spark, sf_dir):
    return _c(P.highpass(spectrum(spark, sf_dir), SHAPE, 0.3, 0.2))


@query(_filtered(f"({HIGH.format(c='0.2', w='0.1')}) * ({LOW.format(c='0.35', w='0.1')})"))
def bandpass(spark, sf_dir):
    return _c(P.bandpass(spectrum(spark, sf_dir), SHAPE, 0.2, 0.35, 0.1, 0.1))


@query(_filtered("exp(-10 * (fy * fy + 2 * fx * fx))"))
def filter_spectrum(spark, sf_dir):
    return _c(P.filter_spectrum(spectrum(spark, sf_dir), SHAPE, lambda fz, fy, fx: F.exp(-10 * (fy * fy + 2 * fx * fx))))


@query(
    SP
    + f""", g as (select *, case when f <= 0.45 then -2 * pi() * ((image_id % 3 - 1) * fy + (image_id % 5) * 0.25 * fx) else 0 end as a from fq)
select image_id, ky, kx, {s6('re * cos(a) - im * sin(a)')} as re, {s6('re * sin(a) + im * cos(a)')} as im from g"""
)
def phase_shift_2d(spark, sf_dir):
    i = F.col("image_id")
    shifts = stack(spark, sf_dir).select("image_id", F.lit(0.0).alias("sz"), (i % 3 - 1.0).alias("sy"), (i % 5 * 0.25).alias("sx"))
    return _c(P.phase_shift(spectrum(spark, sf_dir), shifts, SHAPE, 0.45))


@query(
    SP
    + f""", e as (select image_id, sum(case when ky = 0 and kx = 0 then 0 when kx in (0, 4) then re * re + im * im else 2 * (re * re + im * im) end) as e from sp group by image_id)
select image_id, ky, kx, {s6('case when ky = 0 and kx = 0 then 0 else re / sqrt(e) end')} as re, {s6('case when ky = 0 and kx = 0 then 0 else im / sqrt(e) end')} as im from sp join e using (image_id)"""
)
def standardize_spectrum(spark, sf_dir):
    return _c(P.standardize(spectrum(spark, sf_dir), SHAPE))


CT = """, c0 as (
  select cast(vec_id as bigint) as image_id, 1.8 + 0.2 * (vec_id % 4) as pixel_size, 1 + 0.1 * (vec_id % 20) as defocus, 0.1 * (vec_id % 3) as ps,
    0.05 * (vec_id % 4) as ast, 0.3 * (vec_id % 7) as ang, 1.602176634e-19::double * 300.0::double * 1000.0::double as ev, 9.1093837015e-31::double as m0
  from embeddings
), ct as (
  select *, 6.62607015e-34::double * 299792458.0::double / sqrt(ev * (2 * m0 * 299792458.0::double * 299792458.0::double + ev)) * 1e10::double as wave, -1e4 * defocus as d, -1e4 * ast as da,
    pixel_size * 1.02 as py, pixel_size * 0.98 as pxx, atan(0.1 / sqrt(1 - 0.1 * 0.1)) as k3
  from c0
), c as (
  select *, pi() * wave as k1, 0.5 * pi() * 2.7 * 1e7 * wave * wave * wave as k2 from ct
)"""


def ctfs(spark, sf_dir):
    """A CTF per image, derived from its id."""
    i = F.col("image_id")
    pixel = 1.8 + 0.2 * (i % 4)
    return stack(spark, sf_dir).select(
        "image_id", pixel.alias("pixel_size"), (pixel * 1.02).alias("pixel_y"), (pixel * 0.98).alias("pixel_x"), (1 + 0.1 * (i % 20)).alias("defocus"), F.lit(300.0).alias("voltage"),
        F.lit(0.1).alias("amplitude"), F.lit(2.7).alias("cs"), (0.1 * (i % 3)).alias("phase_shift"), F.lit(-5.0).alias("bfactor"), F.lit(1.0).alias("scale"),
        (0.05 * (i % 4)).alias("astigmatism"), (0.3 * (i % 7)).alias("astig_angle"),
    )


@query(PX + CT + f" select image_id, {s6('wave')} as wavelength, {s6('k1')} as k1, {s6('k2')} as k2, {s6('k3')} as k3, {s6('d')} as defocus_a, {s6('-5.0 / 4')} as b_quarter from c")
def ctf_params(spark, sf_dir):
    return C.params(ctfs(spark, sf_dir)).select("image_id", *[r6(c).alias(c) for c in ("wavelength", "k1", "k2", "k3", "defocus_a", "b_quarter")])


def _phase(r2: str, d: str = "d", c: str = "") -> str:
    return f"({c}k1 * ({r2}) * ({d}) + {c}k2 * ({r2}) * ({r2}) - {c}ps - {c}k3)"


ISO = f"-sin({_phase('(f / pixel_size) * (f / pixel_size)')}) * exp(-1.25 * (f / pixel_size) * (f / pixel_size))"


@query(SP + CT + f", g as (select fq.*, {ISO} as m from fq join c using (image_id)) select image_id, ky, kx, {s6('re * m')} as re, {s6('im * m')} as im, {s6('m')} as ctf, {s6('m * m')} as squared from g")
def ctf_isotropic(spark, sf_dir):
    joined = spectrum(spark, sf_dir).join(C.params(ctfs(spark, sf_dir)), "image_id")
    f = P.norm_fftfreq(SHAPE)
    m = C.isotropic(f)
    return joined.select("image_id", "ky", "kx", r6(F.col("re") * m).alias("re"), r6(F.col("im") * m).alias("im"), r6(m).alias("ctf"), r6(C.isotropic(f, squared=True)).alias("squared"))


ANISO_D = "d + da * cos(2 * (atan2(fy / py, fx / pxx) - ang))"
ANISO_R = "((fy / py) * (fy / py) + (fx / pxx) * (fx / pxx))"


@query(SP + CT + f" select image_id, ky, kx, {s6(f'-sin({_phase(ANISO_R, ANISO_D)}) * exp(-1.25 * {ANISO_R})')} as ctf from fq join c using (image_id)")
def ctf_anisotropic(spark, sf_dir):
    joined = spectrum(spark, sf_dir).join(C.params(ctfs(spark, sf_dir)), "image_id")
    f = P.fftfreq(SHAPE)
    return joined.select("image_id", "ky", "kx", r6(C.anisotropic(f["ky"], f["kx"])).alias("ctf"))


def _inverse(t: str, c: str = "") -> str:
    b = f"({c}k1 * {c}d)"
    disc = f"({b} * {b} + 4 * {c}k2 * ({t} + {c}ps + {c}k3))"
    return f"(case when {disc} >= 0 and (-{b} - sqrt(greatest(0, {disc}))) >= 0 then sqrt(greatest(0, (-{b} - sqrt(greatest(0, {disc}))) / (2 * {c}k2))) end)"


@query(PX + CT + f" select image_id, n, {s6(_inverse('(-n * 7.5)'))} as frequency from c, range(1, 6) as r(n)")
def ctf_phase_inverse(spark, sf_dir):
    each = C.params(ctfs(spark, sf_dir)).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    return each.select("image_id", "n", r6(C.phase_inverse(-F.col("n") * 7.5)).alias("frequency"))


ISO_F = f"coalesce({_inverse('(' + _phase(ANISO_R, ANISO_D) + ')')}, sqrt({ANISO_R})) * (py + pxx) / 2"


@query(SP + CT + f" select image_id, ky, kx, {s6(ISO_F)} as f from fq join c using (image_id)")
def ctf_isotropic_fftfreq(spark, sf_dir):
    joined = spectrum(spark, sf_dir).join(C.params(ctfs(spark, sf_dir)), "image_id")
    f = P.fftfreq(SHAPE)
    return joined.select("image_id", "ky", "kx", r6(C.isotropic_fftfreq(f["ky"], f["kx"])).alias("f"))


TWO = PX + ", two as (select a.image_id, a.y, a.x, a.v, b.v as r from px a join px b on b.image_id = a.image_id + 1 and a.y = b.y and a.x = b.x)"


@query(
    TWO
    + f""", s as (select image_id, 64.0 as n, sum(v) sv, sum(r) sr, sum(v * v) vv, sum(r * r) rr, sum(v * r) vr from two group by image_id)
select image_id, {s6('vr')} as cc, {s6('vr / sqrt(vv * rr)')} as ncc, {s6('(vr - sv * sr / n) / n')} as zcc, {s6('(vr - sv * sr / n) / sqrt((vv - sv * sv / n) * (rr - sr * sr / n))')} as zncc from s"""
)
def cross_correlation_score(spark, sf_dir):
    from .arrays import two

    return X.score(two(spark, sf_dir)).select("image_id", *[r6(c).alias(c) for c in ("cc", "ncc", "zcc", "zncc")])


def _two_spectra(spark, sf_dir):
    s = spectrum(spark, sf_dir)
    return X.zip_spectra(s, s.withColumn("image_id", F.col("image_id") - 1))


def _map(spark, sf_dir):
    product = X.correlation_spectrum(_two_spectra(spark, sf_dir))
    return X.centered(stack_to_pixels(T.fft_c2r(T.from_frequencies(product, SHAPE))), SHAPE)


MAP = (
    PX
    + """, m as (
  select a.image_id, cast(((a.y - b.y + 8) % 8 + 4) % 8 as bigint) as y, cast(((a.x - b.x + 8) % 8 + 4) % 8 as bigint) as x, sum(a.v * b.v) / 64 as v
  from px a join px b on b.image_id = a.image_id + 1 group by 1, 2, 3
)"""
)


@query(MAP + f" select image_id, y, x, {s6('v')} as v from m")
def cross_correlation_map(spark, sf_dir):
    return _map(spark, sf_dir).select("image_id", "y", "x", r6("v").alias("v"))


@query(
    SP
    + f""", p as (select a.image_id, a.ky, a.kx, a.re * b.re + a.im * b.im as re, a.im * b.re - a.re * b.im as im from sp a join sp b on b.image_id = a.image_id + 1 and a.ky = b.ky and a.kx = b.kx),
q as (select *, sqrt(re * re + im * im) as s from p where abs(ky) < 4 and kx < 4)
select image_id, ky, kx, {s6('re / (s + 1e-13)')} as re, {s6('im / (s + 1e-13)')} as im, {s6('re / sqrt(s + 1e-13)')} as mutual_re, {s6('(re * re - im * im) / (s + 1e-13)')} as double_re from q"""
)
def cross_correlation_modes(spark, sf_dir):
    return _modes(_two_spectra(spark, sf_dir).filter((F.abs("ky") < 4) & (F.col("kx") < 4)))


def _modes(both):
    phase = _c(X.correlation_spectrum(both, "phase"))
    mutual = X.correlation_spectrum(both, "mutual").select("image_id", "ky", "kx", r6("re").alias("mutual_re"))
    double = X.correlation_spectrum(both, "double_phase").select("image_id", "ky", "kx", r6("re").alias("double_re"))
    return phase.join(mutual, ["image_id", "ky", "kx"]).join(double, ["image_id", "ky", "kx"])


@query()
def cross_correlation_modes_all(spark, sf_dir):
    """All frequencies, the Nyquist ones too; the tests compare with brute force."""
    return _modes(_two_spectra(spark, sf_dir))


@query(
    MAP
    + f""", i as (select * from m where ((y - 4) / 3.0) * ((y - 4) / 3.0) + ((x - 4) / 3.0) * ((x - 4) / 3.0) <= 1),
b as (select image_id, arg_max(y, v) as y, arg_max(x, v) as x, max(v) as v from i group by image_id),
n as (select b.*, yl.v as yl, yr.v as yr, xl.v as xl, xr.v as xr from b
  join m yl on yl.image_id = b.image_id and yl.y = (b.y + 7) % 8 and yl.x = b.x join m yr on yr.image_id = b.image_id and yr.y = (b.y + 1) % 8 and yr.x = b.x
  join m xl on xl.image_id = b.image_id and xl.y = b.y and xl.x = (b.x + 7) % 8 join m xr on xr.image_id = b.image_id and xr.y = b.y and xr.x = (b.x + 1) % 8),
f as (select *, (yl + yr - 2 * v) / 2 as ya, (yr - yl) / 2 as yb, (xl + xr - 2 * v) / 2 as xa, (xr - xl) / 2 as xb from n),
o as (select *, case when abs(ya) >= 1e-6 then -yb / (2 * ya) else 0 end as dy, case when abs(xa) >= 1e-6 then -xb / (2 * xa) else 0 end as dx from f)
select image_id, {s6('y + dy')} as y, {s6('x + dx')} as x, {s6('v + (ya * dy * dy + yb * dy + xa * dx * dx + xb * dx) / 2')} as value from o where abs(ya) >= 1e-5 and abs(xa) >= 1e-5"""
)
def cross_correlation_peak_2d(spark, sf_dir):
    scaled = _map(spark, sf_dir)
    found = X.peak(scaled, SHAPE, True, (3.0, 3.0, 3.0))
    # parabolas so flat that rounding decides are left out of the comparison
    place = scaled.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), "v")
    inside = place.filter((F.pow((F.col("py") - 4) / 3.0, 2) + F.pow((F.col("px") - 4) / 3.0, 2)) <= 1)
    top = inside.groupBy("image_id").agg(F.max_by("py", "v").alias("ty"), F.max_by("px", "v").alias("tx"), F.max("v").alias("tv"))
    near = place.join(top, "image_id")
    sides = near.groupBy("image_id", "tv").agg(
        F.sum(F.when((F.col("px") == F.col("tx")) & ((F.col("py") == (F.col("ty") + 7) % 8) | (F.col("py") == (F.col("ty") + 1) % 8)), F.col("v"))).alias("ys"),
        F.sum(F.when((F.col("py") == F.col("ty")) & ((F.col("px") == (F.col("tx") + 7) % 8) | (F.col("px") == (F.col("tx") + 1) % 8)), F.col("v"))).alias("xs"),
    )
    curved = sides.filter((F.abs((F.col("ys") - 2 * F.col("tv")) / 2) >= 1e-5) & (F.abs((F.col("xs") - 2 * F.col("tv")) / 2) >= 1e-5)).select("image_id")
    return found.join(curved, "image_id").select("image_id", r6("y").alias("y"), r6("x").alias("x"), r6("value").alias("value"))


@query()
def cross_correlation_peak_2d_all(spark, sf_dir):
    """All images, those with a flat peak too; the tests compare with brute force."""
    found = X.peak(_map(spark, sf_dir), SHAPE, True, (3.0, 3.0, 3.0))
    return found.select("image_id", r6("y").alias("y"), r6("x").alias("x"), r6("value").alias("value"))


FSC = (
    SP
    + """, p as (select a.image_id, a.fy, a.fx, a.f, a.re, a.im, b.re as rr, b.im as ri from fq a join fq b on b.image_id = a.image_id + 1 and a.ky = b.ky and a.kx = b.kx where a.f <= 0.5),
t as (select *, cast(floor(f * 8) as bigint) as shell, 1 - (f * 8 - floor(f * 8)) as share from p union all select *, least(cast(floor(f * 8) as bigint) + 1, 4), f * 8 - floor(f * 8) from p)"""
)
FSC_VALUE = s6("sum(share * (re * rr + im * ri)) / greatest(1e-6, sqrt(sum(share * (re * re + im * im)) * sum(share * (rr * rr + ri * ri))))")


@query(FSC + f" select image_id, shell, {FSC_VALUE} as value from t group by image_id, shell")
def fsc_isotropic(spark, sf_dir):
    return X.fsc_isotropic(_two_spectra(spark, sf_dir), SHAPE).select("image_id", "shell", r6("value").alias("value"))


@query(
    FSC
    + f""", k(cone, cy, cx) as (values (0, 1.0, 0.0), (1, 0.0, 1.0), (2, 0.6, 0.8))
select image_id, cast(cone as bigint) as cone, shell, {FSC_VALUE} as value from t cross join k where f = 0 or abs(fy * cy + fx * cx) >= f * cos(0.5) group by image_id, cone, shell"""
)
def fsc_anisotropic(spark, sf_dir):
    cones = [(0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.6, 0.8)]
    return X.fsc_anisotropic(_two_spectra(spark, sf_dir), SHAPE, cones, 0.5).select("image_id", "cone", "shell", r6("value").alias("value"))


def _split(source: str, f: str, value: str, keys: str, n: int = 5) -> str:
    """CTE t(keys, shell, share, p): the rows of source split between shells of [0, 0.5]."""
    at = f"(({f}) * {n - 1} / 0.5)"
    one = f"select {keys}, {value} as p, {at} as pos, {f} as ff from {source}"
    return f"""u as ({one}), t as (
  select *, cast(floor(pos) as bigint) as shell, 1 - (pos - floor(pos)) as share from u where pos >= 0 and ff <= 0.5
  union all select *, cast(floor(pos) as bigint) + 1, pos - floor(pos) from u where pos >= 0 and ff <= 0.5 and floor(pos) + 1 < {n})"""


AVERAGE = f"select image_id, shell, {s6('case when sum(share) < 1e-12 then 0 else sum(p * share) / sum(share) end')} as value, {s6('sum(share)')} as weight from t group by image_id, shell"


@query(SP + ", " + _split("fq", "f", "re * re + im * im", "image_id") + AVERAGE)
def rotational_average(spark, sf_dir):
    return H.rotational_average(spectrum(spark, sf_dir), SHAPE).select("image_id", "shell", r6("value").alias("value"), r6("weight").alias("weight"))


@query(SP + CT + ", " + _split("(select * from fq join c using (image_id))", ISO_F, "re * re + im * im", "image_id") + AVERAGE)
def rotational_average_anisotropic(spark, sf_dir):
    found = H.rotational_average_anisotropic(spectrum(spark, sf_dir), ctfs(spark, sf_dir), SHAPE)
    return found.select("image_id", "shell", r6("value").alias("value"), r6("weight").alias("weight"))


SHELLS = SP + ", " + _split("fq", "f", "re * re + im * im", "image_id") + ", sh as (select image_id, shell, sum(p * share) / sum(share) as value from t group by image_id, shell)" + CT
TARGET = """, tc as (select ch as chunk, 2.1 as pixel_size, -1e4 * 2.45 as d, 0.5 as ps, k1, k2, k3 from (select distinct image_id // 4 as ch from c), (select k1, k2, k3 from c limit 1))"""


def _target(keyed):
    return keyed.select(
        *keyed.columns, F.lit(2.1).alias("pixel_size"), F.lit(2.45).alias("defocus"), F.lit(300.0).alias("voltage"), F.lit(0.1).alias("amplitude"), F.lit(2.7).alias("cs"),
        F.lit(0.5).alias("phase_shift"), F.lit(0.0).alias("bfactor"), F.lit(1.0).alias("scale"),
    )


SHELL_F = "(shell * 0.5 / 4)"


@query(
    SHELLS
    + TARGET
    + f""", a as (select image_id // 4 as chunk, value, {_phase(f'({SHELL_F} / pixel_size) * ({SHELL_F} / pixel_size)')} as phase from sh join c using (image_id)),
g as (select a.chunk, a.value, {_inverse('a.phase', 'tc.')} * tc.pixel_size as f from a join tc using (chunk)), """
    + _split("g", "f", "value", "chunk").replace("u as (", "uu as (").replace("t as (", "tt as (").replace("from u where", "from uu where")
    + f" select chunk, shell, {s6('case when sum(share) < 1e-12 then 0 else sum(p * share) / sum(share) end')} as value, {s6('sum(share)')} as weight from tt group by chunk, shell"
)
def fuse_spectra(spark, sf_dir):
    shells = H.rotational_average(spectrum(spark, sf_dir), SHAPE).withColumn("chunk", F.floor(F.col("image_id") / 4))
    target = _target(shells.select("chunk").distinct())
    own = ctfs(spark, sf_dir).drop("pixel_y", "pixel_x", "astigmatism", "astig_angle")
    fused = H.fuse_spectra(shells, own, target, 5, 0.0, 0.5)
    return fused.select("chunk", "shell", r6("value").alias("value"), r6("weight").alias("weight"))


@query(
    SHELLS
    + TARGET
    + f""", a as (select c.image_id, shell, {_phase(f'({SHELL_F} / tc.pixel_size) * ({SHELL_F} / tc.pixel_size)', 'tc.d', 'tc.')} as phase from c join tc on tc.chunk = c.image_id // 4, range(5) as r(shell)),
g as (select a.image_id, a.shell as o, {_inverse('a.phase', 'c.')} * c.pixel_size as f from a join c using (image_id)), """
    + _split("g", "f", "o", "image_id, o").replace("u as (", "uu as (").replace("t as (", "tt as (").replace("from u where", "from uu where")
    + f", w as (select tt.image_id, o, sum(value * share) as v from tt join sh using (image_id, shell) group by tt.image_id, o) select a.image_id, a.shell, {s6('coalesce(v, 0)')} as value from a left join w on w.image_id = a.image_id and w.o = a.shell"
)
def phase_spectra(spark, sf_dir):
    shells = H.rotational_average(spectrum(spark, sf_dir), SHAPE)
    own = ctfs(spark, sf_dir).drop("pixel_y", "pixel_x", "astigmatism", "astig_angle")
    found = H.phase_spectra(shells, own, _target(own.select("image_id")), 5, 0.0, 0.5)
    return found.select("image_id", "shell", r6("value").alias("value"))
