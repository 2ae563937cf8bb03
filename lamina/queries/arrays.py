"""Queries of stacks, pixels, generators, element-wise functions and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import elementwise as E
from ..model import exploded, grid
from ..operators import generators as G
from ..operators import neighbourhoods as N
from ..operators import reductions as R
from ..operators import reshape as S
from ..operators import subregions as B
from ..sources import mrc, mrc_source, stacks
from ..sources.shared import shared_folder
from .base import PX, SHAPE, pixels, query, r6, s6, stack


def _v(df):
    return df.select("image_id", "y", "x", r6("v").alias("v"))


@query(
    PX
    + f""", s as (
  select image_id, label, avg(v) as m, stddev_pop(v) as d from px group by image_id, label
)
select px.label, y, x, {s6("avg((v - m) / d)")} as mean from px join s using (image_id) group by px.label, y, x"""
)
def mean_image_per_label(spark, sf_dir):
    images = R.normalize_dense(stack(spark, sf_dir), "mean_std")
    return S.stack_to_pixels(images).groupBy("label", "y", "x").agg(r6(F.avg("v")).alias("mean"))


@query(PX + f" select image_id as volume_id, y as image_id, x, {s6('v')} as v from px")
def read_stack(spark, sf_dir):
    """Images of 8 x 8 stored as volumes of 8 planes of one row, read back as planes."""
    path = shared_folder(spark)
    stacks.write_stack(stack(spark, sf_dir).withColumns({"d": F.lit(8), "h": F.lit(1)}).drop("label"), path)
    planes = stacks.read_stack(spark, path, enforce_2d=True)
    flat = planes.select("volume_id", "image_id", F.posexplode("values").alias("x", "v"))
    return flat.select("volume_id", "image_id", F.col("x").cast("long").alias("x"), r6("v").alias("v"))


@query(
    PX
    + f""", b as (select min(image_id) as low, max(image_id) - min(image_id) + 1 as n from px)
select image_id, y - 2 as y, x, {s6('v')} as v from px, b where image_id >= low + n // 4 and image_id < low + n // 4 + n // 2 and y between 2 and 4"""
)
def read_slices_middle(spark, sf_dir):
    """The middle half of the table's own range of ids."""
    volumes = stack(spark, sf_dir).withColumns({"d": F.lit(8), "h": F.lit(1)})
    low, high = volumes.agg(F.min("image_id"), F.max("image_id")).first()
    n = high - low + 1
    part = stacks.read_slices(volumes, low + n // 4, n // 2, 2, 3)
    return S.stack_to_pixels(part).select("image_id", F.col("z").alias("y"), "x", r6("v").alias("v"))


@query(PX + f" select image_id, y - 2 as y, x, {s6('v')} as v from px where image_id between 40 and 139 and y between 2 and 4")
def read_slices(spark, sf_dir):
    volumes = stack(spark, sf_dir).withColumns({"d": F.lit(8), "h": F.lit(1)})
    part = stacks.read_slices(volumes, 40, 100, 2, 3)
    return S.stack_to_pixels(part).select("image_id", F.col("z").alias("y"), "x", r6("v").alias("v"))


@query(PX + f" select image_id, {s6('min(v)')} as min, {s6('max(v)')} as max, {s6('avg(v)')} as mean, {s6('stddev_pop(v)')} as stddev from px group by image_id")
def write_stack(spark, sf_dir):
    """The statistics that are stored with the images, partitioned by label."""
    path = shared_folder(spark)
    stacks.write_stack(stack(spark, sf_dir), path, ("label",))
    return stacks.read_stack(spark, path).select("image_id", *[r6(c).alias(c) for c in ("min", "max", "mean", "stddev")])


MRC_SQL = (
    PX
    + f""", f as (select image_id, label || '_' || (image_id // 100) as file from px group by all),
k as (select *, row_number() over (partition by file order by image_id) - 1 as k from f)
select file, k as image_id, y, x, {{value}} as v from px join k using (image_id)"""
)


def _files(spark, sf_dir):
    return stack(spark, sf_dir).withColumn("file", F.concat_ws("_", "label", F.floor(F.col("image_id") / 100)))


def _through_storage(spark, files):
    """Files written to a fresh shared folder and read back, with the name of each."""
    folder = shared_folder(spark)
    mrc.save(files.withColumn("path", F.concat("path", F.lit(".mrc"))), folder).write.format("noop").mode("overwrite").save()
    read = S.stack_to_pixels(mrc.read_mrc(spark, folder).drop("spacing"))
    return read.withColumn("file", F.regexp_extract("file", r"([^/]+)\.mrc$", 1))


@query(MRC_SQL.format(value=s6("v")))
def read_mrc(spark, sf_dir):
    read = _through_storage(spark, mrc.to_files(_files(spark, sf_dir), "file", "float32"))
    return read.select("file", "image_id", "y", "x", r6("v").alias("v"))


@query(MRC_SQL.format(value="trunc(greatest(-32768, least(32767, v * 20000.0))) + 0.0"))
def write_mrc(spark, sf_dir):
    scaled = _files(spark, sf_dir).withColumn("values", F.transform("values", lambda v: v * 20000.0))
    read = _through_storage(spark, mrc.to_files(scaled, "file", "int16"))
    return read.select("file", "image_id", "y", "x", (F.col("v") + 0.0).alias("v"))


@query(MRC_SQL.format(value=s6("v")))
def write_mrc_complex(spark, sf_dir):
    """Each image as 8 x 4 complex values, neighbours in a line together."""
    files = _files(spark, sf_dir).withColumn("w", F.lit(4))
    read = mrc.to_files(files, "file", "complex64")
    folder = shared_folder(spark)
    mrc.save(read.withColumn("path", F.concat("path", F.lit(".mrc"))), folder).write.format("noop").mode("overwrite").save()
    back = mrc.read_mrc(spark, folder).withColumn("w", F.size("values") / F.col("h")).drop("spacing")
    out = S.stack_to_pixels(back.withColumn("w", F.col("w").cast("int")))
    return out.select(F.regexp_extract("file", r"([^/]+)\.mrc$", 1).alias("file"), "image_id", "y", "x", r6("v").alias("v"))


def _parts_of(spark, files, dtype):
    """Files written by many tasks each into a fresh shared folder, read through the data source."""
    folder = shared_folder(spark)
    mrc_source.write_mrc(files.withColumn("file", F.concat("file", F.lit(".mrc"))), folder, "file", dtype)
    mrc_source.register(spark)
    return spark.read.format("mrc"), folder


def _named(read):
    return S.stack_to_pixels(read.drop("spacing")).withColumn("file", F.regexp_extract("file", r"([^/]+)\.mrc$", 1))


@query(MRC_SQL.format(value="trunc(greatest(-32768, least(32767, v * 20000.0))) + 0.0"))
def write_mrc_parts(spark, sf_dir):
    scaled = _files(spark, sf_dir).withColumn("values", F.transform("values", lambda v: v * 20000.0))
    source, folder = _parts_of(spark, scaled, "int16")
    return _named(source.load(folder)).select("file", "image_id", "y", "x", (F.col("v") + 0.0).alias("v"))


@query(MRC_SQL.format(value=s6("v")).replace("y, x,", "y - 2 as y, x,") + " where k >= 1 and y between 2 and 4")
def read_mrc_slices(spark, sf_dir):
    """Images of 8 x 8 as volumes of 8 planes of one row: three planes of each image of a file but its first."""
    volumes = _files(spark, sf_dir).withColumns({"d": F.lit(8), "h": F.lit(1)})
    source, folder = _parts_of(spark, volumes, "float32")
    read = source.option("first_plane", 2).option("n_planes", 3).load(folder).filter("image_id >= 1")
    return _named(read).select("file", "image_id", F.col("z").alias("y"), "x", r6("v").alias("v"))


@query(PX + f" select image_id, z, y, x, {s6('v')} as v from px")
def stack_to_pixels(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "z", "y", "x", r6("v").alias("v"))


@query(PX + f" select image_id, y * 8 + x as place, {s6('v')} as v from px")
def pixels_to_stack(spark, sf_dir):
    back = S.pixels_to_stack(pixels(spark, sf_dir), SHAPE)
    return back.select("image_id", F.posexplode("values").alias("p", "v")).select("image_id", F.col("p").cast("long").alias("place"), r6("v").alias("v"))


@query(PX + f" select image_id, (y * 8 + x) // 16 as y, (y * 8 + x) % 16 as x, {s6('v')} as v from px")
def reshape(spark, sf_dir):
    return _v(S.stack_to_pixels(S.reshape(stack(spark, sf_dir), (1, 4, 16))))


@query(PX + f" select image_id, cast(0 as bigint) as y, y * 8 + x as x, {s6('v')} as v from px")
def flat(spark, sf_dir):
    return _v(S.stack_to_pixels(S.flat(stack(spark, sf_dir))))


@query(PX + f" select image_id, x as z, z as y, y as x, {s6('v')} as v from px")
def permute(spark, sf_dir):
    return S.permute(pixels(spark, sf_dir), ("x", "z", "y")).select("image_id", "z", "y", "x", r6("v").alias("v"))


@query(PX + f" select y as image_id, image_id as z, z as y, x, {s6('v')} as v from px")
def permute_batch(spark, sf_dir):
    """Images become the depth of one volume for each of their rows."""
    return S.permute(pixels(spark, sf_dir), ("y", "image_id", "z", "x")).select("image_id", "z", "y", "x", r6("v").alias("v"))


@query(PX + f" select image_id, k as z, y, x, {s6('v')} as v from px, range(3) as r(k)")
def broadcast_stack(spark, sf_dir):
    return S.broadcast_stack(pixels(spark, sf_dir), SHAPE, (3, 8, 8)).select("image_id", "z", "y", "x", r6("v").alias("v"))


@query(PX + f" select image_id, k as z, y, x, {s6('v')} as v from px, range(3) as r(k)")
def broadcast_stack_all(spark, sf_dir):
    return S.broadcast_stack(pixels(spark, sf_dir), SHAPE, (3, 8, 8)).select("image_id", "z", "y", "x", r6("v").alias("v"))


@query(PX + f" select image_id, (y - 1) // 2 as y, x - 5 as x, {s6('v')} as v from px where y >= 1 and y < 7 and (y - 1) % 2 = 0 and x >= 5")
def subregion(spark, sf_dir):
    return _v(S.subregion(pixels(spark, sf_dir), SHAPE, Ellipsis, slice(1, -1, 2), slice(-3, None)))


@query(PX + f" select image_id * 2 + k as image_id, image_id as source_id, y, x, {s6('v')} as v from px, range(2) as r(k)")
def copy_batches(spark, sf_dir):
    images = stack(spark, sf_dir)
    picks = exploded(images.select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))).select((F.col("image_id") * 2 + F.col("k")).alias("out_pos"), "image_id")
    copied = S.copy_batches(images.drop("label"), picks)
    return S.stack_to_pixels(copied).select("image_id", "source_id", "y", "x", r6("v").alias("v"))


@query(PX + " select image_id, y, x, cast(trunc(greatest(-128, least(127, v * 400.0))) as bigint) as v from px")
def cast_stack(spark, sf_dir):
    scaled = pixels(spark, sf_dir).withColumn("v", F.col("v") * 400.0)
    return S.cast_stack(scaled, "int8").select("image_id", "y", "x", F.col("v").cast("long").alias("v"))


@query(
    PX
    + """ select image_id, sum(cast(v > 0.1 as bigint))::bigint as above, sum(cast(v > -0.1 and v < 0.1 as bigint))::bigint as within,
  sum(cast(v between -0.2 and 0.2 as bigint))::bigint as within_equal, sum(cast(isnan(v) or isinf(v) as bigint))::bigint as odd, sum(cast(v = 0 as bigint))::bigint as zero
from px group by image_id"""
)
def filter_predicates(spark, sf_dir):
    v = F.col("v")
    masks = {
        "above": E.PREDICATES["greater"](v, F.lit(0.1)),
        "within": E.PREDICATES["within"](v, F.lit(-0.1), F.lit(0.1)),
        "within_equal": E.PREDICATES["within_equal"](v, F.lit(-0.2), F.lit(0.2)),
        "odd": ~E.PREDICATES["is_finite"](v),
        "zero": E.PREDICATES["is_zero"](v),
    }
    return pixels(spark, sf_dir).groupBy("image_id").agg(*[F.sum(m.cast("long")).alias(n) for n, m in masks.items()])


def _images(spark, sf_dir):
    """image_id and batch (the image's place in the stack) of every image."""
    return stack(spark, sf_dir).select("image_id", F.col("image_id").alias("batch"))


@query("select cast(vec_id as bigint) as image_id, cast(i as bigint) as place, 2.5::double as v from embeddings, range(12) as r(i)")
def fill_stack(spark, sf_dir):
    filled = G.fill_stack(_images(spark, sf_dir), (1, 3, 4), 2.5)
    return filled.select("image_id", F.posexplode("values").alias("p", "v")).select("image_id", F.col("p").cast("long").alias("place"), "v")


GRID = "select cast(vec_id as bigint) as image_id, cast(i // 4 as bigint) as y, cast(i % 4 as bigint) as x, {v} as v from embeddings, range(12) as r(i)"


@query(GRID.format(v="cast(1.5 + (vec_id * 12 + i) * 0.25 as double)"))
def arange_stack(spark, sf_dir):
    return _v(G.arange_stack(_images(spark, sf_dir), (1, 3, 4), 1.5, 0.25))


@query(
    """with n as (select count(*) * 12 as n from embeddings)
select cast(vec_id as bigint) as image_id, cast(i // 4 as bigint) as y, cast(i % 4 as bigint) as x,
  round(cast(case when vec_id * 12 + i = n - 1 then 4.0 else -1.0 + (vec_id * 12 + i) * (5.0 / (n - 1)) end as double), 6) + 0.0 as v
from embeddings, range(12) as r(i), n"""
)
def linspace_stack(spark, sf_dir):
    images = _images(spark, sf_dir)
    return _v(G.linspace_stack(images, images.count(), (1, 3, 4), -1.0, 4.0))


@query(GRID.format(v="cast(((vec_id % 2) * 6 + ((i // 4) % 2) * 3 + (i % 4) % 3) as double)"))
def iota_tiled(spark, sf_dir):
    return _v(G.iota_tiled(_images(spark, sf_dir), (1, 3, 4), (1, 2, 3), 2))


def _draw(stream: int) -> str:
    return f"((('0x' || substr(md5('1:' || vec_id || ':' || i || ':{stream}'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)"


NORMAL = f"sqrt(-2 * ln({_draw(0)})) * cos(2 * pi() * {_draw(1)})"


@query(
    f"""select image_id, y, x, {s6('uniform')} as uniform, {s6('normal')} as normal, {s6('lognormal')} as lognormal, poisson from (
  select cast(vec_id as bigint) as image_id, cast(i // 4 as bigint) as y, cast(i % 4 as bigint) as x, -1.0 + {_draw(0)} * 2.0 as uniform, 1.0 + {NORMAL} * 2.0 as normal,
    exp({NORMAL} * 0.5) as lognormal,
    cast({" + ".join(f"len(list_filter({G.poisson_table(5.0)}::double[], lambda v: v < {_draw(k)}))" for k in range(2))} as double) as poisson
  from embeddings, range(12) as r(i))"""
)
def random_values(spark, sf_dir):
    """The values of random_stack."""
    images = _images(spark, sf_dir).select("image_id")
    out = None
    for kind, p in {"uniform": (-1.0, 1.0), "normal": (1.0, 2.0), "lognormal": (0.0, 0.5), "poisson": (10.0, 0.0)}.items():
        one = S.stack_to_pixels(G.random_stack(images, (1, 3, 4), kind, *p)).select("image_id", "y", "x", r6("v").alias(kind))
        out = one if out is None else out.join(one, ["image_id", "y", "x"])
    return out


@query(
    f"""with d as (
  select vec_id, -1.0 + {_draw(0)} * 2.0 as uniform, 1.0 + {NORMAL} * 2.0 as normal, exp({NORMAL} * 0.5) as lognormal,
    cast(len(list_filter({G.poisson_table(3.0)}::double[], lambda v: v < {_draw(0)})) as double) as poisson
  from embeddings, range(64) as r(i)
)
"""
    + " union all ".join(f"select cast(vec_id as bigint) as image_id, '{k}' as kind, {s6(f'avg({k})')} as mean, {s6(f'stddev_pop({k})')} as stddev from d group by vec_id" for k in ("uniform", "normal", "lognormal", "poisson"))
)
def random_stack(spark, sf_dir):
    images = _images(spark, sf_dir).select("image_id")
    kinds = {"uniform": (-1.0, 1.0), "normal": (1.0, 2.0), "lognormal": (0.0, 0.5), "poisson": (3.0, 0.0)}
    drawn = [stacks.statistics(G.random_stack(images, SHAPE, k, *p)).select("image_id", F.lit(k).alias("kind"), r6("mean").alias("mean"), r6("stddev").alias("stddev")) for k, p in kinds.items()]
    return drawn[0].union(drawn[1]).union(drawn[2]).union(drawn[3])


@query(
    """with t as (
  select cast(vec_id as bigint) as image_id, cast(i as bigint) as i, 1.0 + (vec_id % 3) as s, i - 5.0 as u from embeddings, range(11) as r(i)
), w as (
  select image_id, i, exp(-(u * u) / (2 * 2.0 * 2.0)) as gaussian, 0.42 - 0.5 * cos(2 * pi() * i / 10) + 0.08 * cos(4 * pi() * i / 10) as blackman,
    case when u = 0 then 0.3 else sin(pi() * 0.3 * u) / (pi() * u) end as sinc
  from t
)
select image_id, i - 5 as i, round(gaussian / sum(gaussian) over p, 6) + 0.0 as gaussian, round(blackman, 6) + 0.0 as blackman, round(sinc / sum(sinc) over p, 6) + 0.0 as sinc
from w window p as (partition by image_id) qualify i >= 5"""
)
def windows(spark, sf_dir):
    lines = stack(spark, sf_dir).select("image_id")
    kinds = {"gaussian": (2.0, True), "blackman": (0.0, False), "sinc": (0.3, True)}
    out = None
    for kind, (param, normalize) in kinds.items():
        taps = G.window(lines, kind, 11, param, half=True, normalize=normalize).select("image_id", "i", r6("v").alias(kind))
        out = taps if out is None else out.join(taps, ["image_id", "i"])
    return out


@query(
    PX
    + """, m as (
  select *, 4.0 + image_id % 2 as cy, 3.5 as cx, 1.5 + image_id % 3 as ry, 2.0 as rx, image_id % 4 = 0 as inv from px
), d as (
  select *, sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) - rx as ds, abs(y - cy) - ry as dy, abs(x - cx) - rx as dx from m
), e as (
  select *, case when ds <= 0 then 1.0 when ds >= 1.5 then 0.0 else 0.5 + 0.5 * cos(pi() * ds / 1.5) end as sphere,
    (case when dy <= 0 then 1.0 when dy >= 1.5 then 0.0 else 0.5 + 0.5 * cos(pi() * dy / 1.5) end)
    * (case when dx <= 0 then 1.0 when dx >= 1.5 then 0.0 else 0.5 + 0.5 * cos(pi() * dx / 1.5) end) as rectangle
  from d
)
select image_id, y, x, round(v * 0.8 * (case when inv then 1 - sphere else sphere end), 6) + 0.0 as sphere,
  round(v * 0.8 * (case when inv then 1 - rectangle else rectangle end), 6) + 0.0 as rectangle from e"""
)
def draw_mask(spark, sf_dir):
    px = pixels(spark, sf_dir)
    i = F.col("image_id")
    masks = stack(spark, sf_dir).select(
        "image_id", (4.0 + i % 2).alias("cy"), F.lit(3.5).alias("cx"), (1.5 + i % 3).alias("ry"), F.lit(2.0).alias("rx"),
        F.lit(1.5).alias("smoothness"), F.lit(0.8).alias("cvalue"), (i % 4 == 0).alias("invert"),
    )
    drawn = [G.draw_mask(px, masks, s).select("image_id", "y", "x", r6("v").alias(s)) for s in ("sphere", "rectangle")]
    return drawn[0].join(drawn[1], ["image_id", "y", "x"])


@query(
    PX
    + """, m as (
  select *, 0.8 * (y - 3.5) + 0.6 * (x - 3.5) + 4.0 + image_id % 2 as py, -0.6 * (y - 3.5) + 0.8 * (x - 3.5) + 3.5 as px from px
), d as (
  select *, abs(py - 4.0) - 2.0 as dy, abs(px - 3.5) - 1.5 as dx from m
), e as (
  select *, 0.8 * (case when dy <= 0 then 1.0 when dy >= 1.5 then 0.0 else 0.5 + 0.5 * cos(pi() * dy / 1.5) end)
    * (case when dx <= 0 then 1.0 when dx >= 1.5 then 0.0 else 0.5 + 0.5 * cos(pi() * dx / 1.5) end) as mask from d
)
select image_id, y, x, round(v + mask, 6) + 0.0 as added, round(mask, 6) + 0.0 as alone from e"""
)
def draw_mask_moved(spark, sf_dir):
    """A turned rectangle, added to the images, and alone."""
    zero, one = F.lit(0.0), F.lit(1.0)
    turn = [one, zero, zero, zero, zero, F.lit(0.8), F.lit(0.6), 4.0 + F.col("image_id") % 2 - 0.8 * 3.5 - 0.6 * 3.5, zero, F.lit(-0.6), F.lit(0.8), F.lit(3.5 + 0.6 * 3.5 - 0.8 * 3.5)]
    value = {"cy": 4.0, "cx": 3.5, "ry": 2.0, "rx": 1.5, "smoothness": 1.5, "cvalue": 0.8}
    images = stack(spark, sf_dir)
    masks = images.select("image_id", *[F.lit(v).alias(k) for k, v in value.items()], F.lit(False).alias("invert"), F.array(*turn).alias("matrix"))
    added = G.draw_mask(pixels(spark, sf_dir), masks, "rectangle", operator=lambda v, m: v + m).select("image_id", "y", "x", r6("v").alias("added"))
    return added.join(G.mask_stack(images, masks, SHAPE, "rectangle").select("image_id", "y", "x", r6("v").alias("alone")), ["image_id", "y", "x"])


UNARY_SQL = {
    "negate": "-v", "square": "v * v", "rint": "round_even(v * 3, 0)", "ceil": "ceil(v)", "floor": "floor(v)", "trunc": "trunc(v * 5)",
    "sqrt": "sqrt(abs(v))", "exp": "exp(v)", "log1p": "ln(1 + v)", "abs": "abs(v)", "cos": "cos(v)", "sin": "sin(v)", "tan": "tan(v)",
    "acos": "acos(v)", "asin": "asin(v)", "atan": "atan(v)", "cosh": "cosh(v)", "sinh": "sinh(v)", "tanh": "tanh(v)", "asinh": "asinh(v)", "atanh": "atanh(v)",
    "sinc": "case when v = 0 then 1 else sin(v) / v end", "rad2deg": "degrees(v)", "deg2rad": "radians(v)", "one_minus": "1 - v", "abs_one_log": "ln(1 + abs(v))",
}
UNARY_INPUT = {"rint": lambda v: v * 3, "trunc": lambda v: v * 5, "sqrt": F.abs}


@query(PX + " select image_id, y, x, " + ", ".join(f"{s6(e)} as {n}" for n, e in UNARY_SQL.items()) + " from px")
def ewise_unary(spark, sf_dir):
    v = F.col("v")
    return pixels(spark, sf_dir).select("image_id", "y", "x", *[r6(E.UNARY[n](UNARY_INPUT.get(n, lambda c: c)(v))).alias(n) for n in UNARY_SQL])


BINARY_SQL = {
    "plus": "v + r", "minus": "v - r", "multiply": "v * r", "min": "least(v, r)", "max": "greatest(v, r)", "hypot": "sqrt(v * v + r * r)",
    "copysign": "case when r < 0 then -abs(v) else abs(v) end", "distance_squared": "(v - r) * (v - r)",
}
TWO = PX + ", two as (select a.image_id, a.y, a.x, a.v, b.v as r from px a join px b on b.image_id = a.image_id + 1 and a.y = b.y and a.x = b.x)"


def two(spark, sf_dir):
    """Each image beside the next one."""
    px = pixels(spark, sf_dir).drop("label")
    return E.zip_stacks(px, px.withColumn("image_id", F.col("image_id") - 1))


@query(TWO + " select image_id, y, x, " + ", ".join(f"{s6(e)} as {n}" for n, e in BINARY_SQL.items()) + " from two")
def ewise_binary(spark, sf_dir):
    return two(spark, sf_dir).select("image_id", "y", "x", *[r6(E.BINARY[n](F.col("v"), F.col("r"))).alias(n) for n in BINARY_SQL])


@query(TWO + f" select image_id, y, x, {s6('greatest(-0.1, least(0.1, v))')} as clamp, {s6('v * r + 0.5')} as fma, {s6('(v + r) * 0.5')} as plus_multiply, {s6('(v - r) / 0.5')} as minus_divide from two")
def ewise_ternary(spark, sf_dir):
    v, r, half = F.col("v"), F.col("r"), F.lit(0.5)
    return two(spark, sf_dir).select(
        "image_id", "y", "x", r6(E.TERNARY["clamp"](v, F.lit(-0.1), F.lit(0.1))).alias("clamp"),
        *[r6(E.TERNARY[n](v, r, half)).alias(n) for n in ("fma", "plus_multiply", "minus_divide")],
    )


@query(TWO + f" select image_id, y, x, {s6('sqrt(v * v + r * r)')} as abs, {s6('v * v + r * r')} as power, {s6('v * r + r * v')} as re, {s6('r * r - v * v')} as im from two")
def complex_ops(spark, sf_dir):
    a, b = (F.col("v"), F.col("r")), (F.col("r"), F.col("v"))
    re, im = E.times_conjugate(a, b)
    return two(spark, sf_dir).select("image_id", "y", "x", r6(E.magnitude(*a)).alias("abs"), r6(E.power(*a)).alias("power"), r6(re).alias("re"), r6(im).alias("im"))


REDUCE_SQL = {
    "min": "min(v)", "max": "max(v)", "sum": "sum(v)", "mean": "avg(v)", "l2_norm": "sqrt(sum(v * v))", "variance": "var_pop(v)", "stddev_1": "stddev_samp(v)",
    "mean_l2_norm": "sqrt(var_pop(v) * count(v))", "median": "median(v)",
}


def _reduced(keys):
    sql = ", ".join([*keys, *[f"{s6(e)} as {n}" for n, e in REDUCE_SQL.items()]])
    return PX + f" select {sql} from px" + (f" group by {', '.join(keys)}" if keys else "")


def _reduce(spark, sf_dir, keys):
    return R.reduce(pixels(spark, sf_dir), keys, *REDUCE_SQL).select(*keys, *[r6(n).alias(n) for n in REDUCE_SQL])


@query(_reduced(["image_id"]))
def reduce_per_image(spark, sf_dir):
    return _reduce(spark, sf_dir, ["image_id"])


@query(_reduced(["y", "x"]))
def reduce_over_images(spark, sf_dir):
    return _reduce(spark, sf_dir, ["y", "x"])


@query(_reduced(["image_id", "y"]))
def reduce_width(spark, sf_dir):
    return _reduce(spark, sf_dir, ["image_id", "y"])


@query(_reduced([]))
def reduce_whole(spark, sf_dir):
    return _reduce(spark, sf_dir, [])


@query(PX + f" select label, {s6('sum(v)')} as sum, {s6('avg(v)')} as mean from px group by label")
def reduce_accurate(spark, sf_dir):
    return R.reduce_accurate(pixels(spark, sf_dir), ["label"]).select("label", r6("sum").alias("sum"), r6("mean").alias("mean"))


CANCELLING = """with px as (
  select l_returnflag as flag, cast(cast(l_orderkey as bigint) * 1099511627776 as hugeint) as large, l_quantity as small, l_linenumber % 2 as side from lineitem
)"""


@query(
    CANCELLING
    + """ select flag, cast(sum(large * 1048576) - sum(large * 1048576) + sum(cast(small as bigint)) as double) as sum,
  cast(sum(cast(small as bigint)) as double) / cast(3 * count(*) as double) as mean from px group by flag"""
)
def reduce_accurate_cancelling(spark, sf_dir):
    """Values of 2**60 and more and their negatives around the quantities: a sum that rounds on the way is far off."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    large = F.col("l_orderkey").cast("double") * float(1 << 60)
    values = F.explode(F.array(large, F.col("l_quantity").cast("double"), -large))
    return R.reduce_accurate(lines.select(F.col("l_returnflag").alias("flag"), values.alias("v")), ["flag"]).select("flag", "sum", "mean")


@query(TWO + f" select image_id, {s6('sqrt(avg((v - r) * (v - r)))')} as rmsd, {s6('sum(v * r)')} as dot, bool_and(v = r) as all_equal from two group by image_id")
def rmsd_dot_equal(spark, sf_dir):
    return R.compare(two(spark, sf_dir), ["image_id"]).select("image_id", r6("rmsd").alias("rmsd"), r6("dot").alias("dot"), "all_equal")


@query(
    PX
    + f""", r as (select *, round(v, 1) as w, y * 8 + x as p from px),
a as (select image_id, max(w) as hi, min(w) as lo from r group by image_id)
select image_id, {s6('max(hi)')} as max, min(p) filter (w = hi) as argmax, {s6('min(lo)')} as min, min(p) filter (w = lo) as argmin
from r join a using (image_id) group by image_id"""
)
def argmax_argmin(spark, sf_dir):
    ties = pixels(spark, sf_dir).withColumn("v", F.round("v", 1))
    place = F.col("y") * 8 + F.col("x")
    hi = R.argument(ties, ["image_id"], place).select("image_id", r6("value").alias("max"), F.col("place").alias("argmax"))
    lo = R.argument(ties, ["image_id"], place, largest=False).select("image_id", r6("value").alias("min"), F.col("place").alias("argmin"))
    return hi.join(lo, "image_id")


@query(
    PX
    + f""", s as (select image_id, min(v) as lo, max(v) as hi, avg(v) as m, stddev_pop(v) as d, sqrt(sum(v * v)) as l, sqrt(var_pop(v) * count(*)) as c from px group by image_id)
select image_id, y, x, {s6('(v - lo) / (hi - lo)')} as min_max, {s6('(v - m) / d')} as mean_std, {s6('v / l')} as l2, {s6('(v - m) / c')} as mean_l2 from px join s using (image_id)"""
)
def normalize_per_image(spark, sf_dir):
    images = stack(spark, sf_dir)
    out = None
    for mode in ("min_max", "mean_std", "l2", "mean_l2"):
        one = S.stack_to_pixels(R.normalize_dense(images, mode)).select("image_id", "y", "x", r6("v").alias(mode))
        out = one if out is None else out.join(one, ["image_id", "y", "x"])
    return out


@query(PX + f", s as (select avg(v) as m, stddev_pop(v) as d from px) select image_id, y, x, {s6('(v - m) / d')} as v from px, s")
def normalize_whole(spark, sf_dir):
    return _v(R.normalize(pixels(spark, sf_dir), "mean_std", ()))


@query(PX + f", s as (select y, x, min(v) as lo, max(v) as hi from px group by y, x) select image_id, y, x, {s6('(v - lo) / (hi - lo)')} as v from px join s using (y, x)")
def normalize_axes(spark, sf_dir):
    return _v(R.normalize(pixels(spark, sf_dir), "min_max", ("y", "x")))


@query(
    PX
    + """, b as (select image_id, cast(greatest(0, least(15, round((v + 1) / 2 * 16))) as bigint) as bin, count(*) as n from px group by 1, 2)
select i.image_id, k as bin, coalesce(n, 0) as n from (select distinct image_id from px) i cross join range(16) as r(k) left join b on b.image_id = i.image_id and b.bin = k"""
)
def histogram(spark, sf_dir):
    return R.histogram(pixels(spark, sf_dir).withColumn("v", (F.col("v") + 1) / 2), 16)


@query(
    PX
    + f""" select a.image_id, a.y as y, b.y as x, {s6('2 * sum(a.v * b.v) + 0.5 * max(c.v)')} as v
from px a join px b on b.image_id = a.image_id + 1 and a.x = b.x join px c on c.image_id = a.image_id and c.y = a.y and c.x = b.y group by a.image_id, a.y, b.y"""
)
def matmul(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return _v(R.matmul(px, px.withColumn("image_id", F.col("image_id") - 1), 2.0, 0.5, px, transpose_b=True))


@query(
    PX
    + f""", s as (select image_id, y, 8.0 as n, sum(x) s1, sum(x * x) s2, sum(x * x * x) s3, sum(x * x * x * x) s4, sum(v) t0, sum(v * x) t1, sum(v * x * x) t2 from px group by image_id, y),
d as (select *, s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2) as w from s)
select image_id, y, {s6('(t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / w')} as a,
  {s6('(s4 * (t1 * n - s1 * t0) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / w')} as b,
  {s6('(s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2)) / w')} as c from d"""
)
def lstsq_quadratic(spark, sf_dir):
    fit = R.lstsq_quadratic(pixels(spark, sf_dir), ["image_id", "y"])
    return fit.select("image_id", "y", *[r6(c).alias(c) for c in "abc"])


@query(PX + f" select image_id, y, row_number() over (partition by image_id, y order by v desc, x) - 1 as x, {s6('v')} as v from px")
def sort_axis(spark, sf_dir):
    return _v(R.sort_axis(pixels(spark, sf_dir), "x", ascending=False))


KERNEL = [[0.05, 0.1, 0.05], [0.1, 0.4, 0.1], [0.05, 0.15, 0.0]]
KERNEL_SQL = ", kern(dy, dx, k) as (values " + ", ".join(f"({i - 1}, {j - 1}, {KERNEL[i][j]})" for i in range(3) for j in range(3)) + ")"


@query(PX + KERNEL_SQL + f" select p.image_id, p.y, p.x, {s6('sum(q.v * k)')} as v from px p cross join kern join px q on q.image_id = p.image_id and q.y = p.y + dy and q.x = p.x + dx group by p.image_id, p.y, p.x")
def convolve(spark, sf_dir):
    return _v(N.convolve(pixels(spark, sf_dir), SHAPE, KERNEL))


def _reflected(axis: str, offset: str) -> str:
    i = f"abs(p.{axis} + {offset})"
    return f"case when {i} >= 8 then 14 - {i} else {i} end"


@query(PX + KERNEL_SQL + f" select p.image_id, p.y, p.x, {s6('sum(q.v * k)')} as v from px p cross join kern join px q on q.image_id = p.image_id and q.y = {_reflected('y', 'dy')} and q.x = {_reflected('x', 'dx')} group by p.image_id, p.y, p.x")
def convolve_reflect(spark, sf_dir):
    return _v(S.stack_to_pixels(N.convolve_dense(stack(spark, sf_dir), KERNEL, "reflect")))


LINE = [0.25, 0.5, 0.2]


@query(
    PX
    + f""", c as (select image_id, y, x, 0.25 * coalesce(lag(v) over p, 0) + 0.5 * v + 0.2 * coalesce(lead(v) over p, 0) as v from px window p as (partition by image_id, x order by y))
select image_id, y, x, {s6('0.25 * coalesce(lag(v) over p, 0) + 0.5 * v + 0.2 * coalesce(lead(v) over p, 0)')} as v from c window p as (partition by image_id, y order by x)"""
)
def convolve_separable(spark, sf_dir):
    return _v(N.convolve_separable(pixels(spark, sf_dir), {"y": LINE, "x": LINE}))


@query(
    PX
    + f""", k(d, w) as (values (-1, 0.25), (0, 0.5), (1, 0.2)),
c as (select p.image_id, p.y, p.x, sum(q.v * w) as v from px p cross join k join px q on q.image_id = p.image_id and q.x = p.x and q.y = {_reflected('y', 'd')} group by 1, 2, 3)
select p.image_id, p.y, p.x, {s6('sum(q.v * w)')} as v from c p cross join k join c q on q.image_id = p.image_id and q.y = p.y and q.x = {_reflected('x', 'd')} group by 1, 2, 3"""
)
def convolve_separable_reflect(spark, sf_dir):
    return _v(N.convolve_separable(pixels(spark, sf_dir), {"y": LINE, "x": LINE}, "reflect", SHAPE))


MEDIAN_SQL = (
    PX
    + f""" select p.image_id, p.y, p.x, {s6('median(q.v)')} as v from px p cross join range(-1, 2) as r(dy) cross join range(-1, 2) as t(dx)
join px q on q.image_id = p.image_id and q.y = {_reflected('y', 'dy')} and q.x = {_reflected('x', 'dx')} group by p.image_id, p.y, p.x"""
)


@query(MEDIAN_SQL)
def median_filter_2d(spark, sf_dir):
    return _v(N.median_filter(pixels(spark, sf_dir), SHAPE, (1, 3, 3)))


@query(MEDIAN_SQL)
def median_filter_dense(spark, sf_dir):
    return _v(S.stack_to_pixels(N.median_filter_dense(stack(spark, sf_dir), (1, 3, 3))))


@query(
    PX
    + f""" select p.image_id, p.y, p.x, {s6('median(coalesce(q.v, 0.0))')} as v from px p cross join range(-1, 2) as t(dx)
left join px q on q.image_id = p.image_id and q.y = p.y and q.x = p.x + dx group by p.image_id, p.y, p.x"""
)
def median_filter_1d(spark, sf_dir):
    return _v(N.median_filter(pixels(spark, sf_dir), SHAPE, (1, 1, 3), "zero"))


BORDERS = {
    "zero": "case when {i} between 0 and 7 then {i} end",
    "clamp": "greatest(0, least(7, {i}))",
    "periodic": "(({i}) % 8 + 8) % 8",
    "mirror": "case when (case when {i} < 0 then -({i}) - 1 else {i} end) % 16 >= 8 then 15 - (case when {i} < 0 then -({i}) - 1 else {i} end) % 16 else (case when {i} < 0 then -({i}) - 1 else {i} end) % 16 end",
    "reflect": "case when abs({i}) % 14 >= 8 then 14 - abs({i}) % 14 else abs({i}) % 14 end",
}
RESIZE_SQL = (
    PX
    + ", ".join(
        [
            "",
            *[
                f"b_{m} as (select i.image_id, '{m}' as mode, y, x, coalesce(p.v, 0.0) as v from (select distinct image_id from px) i cross join range(10) as r(y) cross join range(13) as t(x) left join px p on p.image_id = i.image_id and p.y = {e.format(i='(y - 4)')} and p.x = {e.format(i='(x - 3)')})"
                for m, e in BORDERS.items()
            ],
        ]
    ).replace("as r(y)", "as r(yy)").replace("as t(x)", "as t(xx)").replace("(y - 4)", "(yy - 4)").replace("(x - 3)", "(xx - 3)").replace("mode, y, x,", "mode, yy as y, xx as x,")
    + " "
    + " union all ".join(f"select image_id, mode, y, x, {s6('v')} as v from b_{m}" for m in BORDERS)
)


@query(RESIZE_SQL)
def resize_stack(spark, sf_dir):
    px, images = pixels(spark, sf_dir), stack(spark, sf_dir)
    out = None
    for mode in BORDERS:
        one = B.resize_stack(px, images, SHAPE, [(0, 0), (4, -2), (3, 2)], mode).select("image_id", F.lit(mode).alias("mode"), "y", "x", r6("v").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def _boxes(spark, sf_dir):
    i = F.col("image_id")
    twice = stack(spark, sf_dir).select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return twice.select(
        (i * 2 + F.col("k")).alias("box_id"), "image_id", F.lit(0).cast("long").alias("oz"), (i % 9 - 2 + F.col("k")).alias("oy"), (i % 7 - 2).alias("ox")
    )


BOXES = PX + ", boxes as (select vec_id * 2 + k as box_id, cast(vec_id as bigint) as image_id, vec_id % 9 - 2 + k as oy, vec_id % 7 - 2 as ox from embeddings, range(2) as r(k))"


@query(BOXES + f" select box_id, b.image_id, yy as y, xx as x, {s6('coalesce(v, 0.0)')} as v from boxes b cross join range(4) as r(yy) cross join range(5) as t(xx) left join px p on p.image_id = b.image_id and p.y = yy + oy and p.x = xx + ox")
def extract_subregions(spark, sf_dir):
    cut = B.extract_subregions(pixels(spark, sf_dir), _boxes(spark, sf_dir), SHAPE, (1, 4, 5))
    return cut.select("box_id", "image_id", "y", "x", r6("v").alias("v"))


@query(
    BOXES
    + f""", w as (select b.image_id, yy + oy as y, xx + ox as x, max_by(box_id * 100 + yy * 10 + xx, box_id) as v from boxes b cross join range(4) as r(yy) cross join range(5) as t(xx) group by 1, 2, 3)
select px.image_id, px.y, px.x, {s6('coalesce(cast(w.v as double), px.v)')} as v from px left join w on w.image_id = px.image_id and w.y = px.y and w.x = px.x"""
)
def insert_subregions(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    filled = grid(boxes.select("box_id"), (1, 4, 5)).withColumn("v", (F.col("box_id") * 100 + F.col("y") * 10 + F.col("x")).cast("double"))
    return _v(B.insert_subregions(pixels(spark, sf_dir), filled, boxes))


@query("with n as (select cast(ceil(sqrt(count(*))) as bigint) as c from embeddings) select cast(vec_id as bigint) as image_id, cast(vec_id // c * 8 as bigint) as oy, cast(vec_id % c * 8 as bigint) as ox from embeddings, n")
def atlas_layout(spark, sf_dir):
    images = stack(spark, sf_dir)
    at = B.atlas_layout(F.col("image_id"), images.count(), 8, 8)
    return images.select("image_id", *[c.alias(k) for k, c in at.items()])


@query(PX + f" select image_id, {s6('sum(v * v) / count(*)')} as value from px group by image_id")
def reduce_ewise(spark, sf_dir):
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    found = R.reduce_ewise(stack(spark, sf_dir), zero, lambda a, v: F.struct((a["s"] + v * v).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"] / a["n"])
    return found.select("image_id", r6("value").alias("value"))


@query(GRID.format(v="round(sin(vec_id * 0.1) * (i // 4) + (i % 4), 6) + 0.0"))
def iwise(spark, sf_dir):
    return _v(G.iwise(_images(spark, sf_dir), (1, 3, 4), lambda b, z, y, x: F.sin(b * 0.1) * y + x))


@query(
    """with g as (select cast(vec_id as bigint) as image_id, cast(i // 4 as bigint) as y, (vec_id % 7) * 0.5 + (i // 4) * (i % 4) - i % 4 as v from embeddings, range(12) as r(i))
select image_id, y, round(cast(max(v) as double), 6) + 0.0 as largest, round(cast(sum(v) as double), 6) + 0.0 as total from g group by image_id, y"""
)
def reduce_iwise(spark, sf_dir):
    found = R.reduce_iwise(_images(spark, sf_dir), (1, 3, 4), ["image_id", "y"], lambda b, z, y, x: b % 7 * 0.5 + y * x - x, largest=F.max, total=F.sum)
    return found.select("image_id", "y", r6("largest").alias("largest"), r6("total").alias("total"))


@query(TWO + f" select image_id, y, x, {s6('v * 2 + r')} as v from two")
def ewise(spark, sf_dir):
    return two(spark, sf_dir).select("image_id", "y", "x", r6(F.col("v") * 2 + F.col("r")).alias("v"))
