"""Queries of the jobs and of the streaming sums."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..jobs import workloads as K
from ..operators import projection as J
from ..operators.reshape import stack_to_pixels
from ..operators.spectra import phase_shift
from ..sources.shared import shared_folder
from ..streaming.accumulate import VolumeSink, accumulate_shells
from .arrays import BOXES, _boxes
from .base import PX, SHAPE, pixels, query, r6, s6, stack
from .fourier import SP, spectrum
from .geometry import RASTER, VOLUME, _pose, _turn


@query(
    BOXES
    + """, cut as (
  select box_id, yy as y, xx as x, coalesce(v, 0.0) as v from boxes b cross join range(4) as r(yy) cross join range(4) as t(xx)
  left join px p on p.image_id = b.image_id and p.y = yy + oy and p.x = xx + ox
), n as (
  select box_id, y, x, (v - avg(v) over w) / stddev_pop(v) over w as v from cut window w as (partition by box_id)
), f as (
  select box_id, ky, kx, sum(v * cos(a)) / 16 as re, sum(v * sin(a)) / 16 as im, any_value(m) as m
  from (select *, -2 * pi() * (ky * y + kx * x) / 4 as a, case when q >= 0.15 then 1.0 when q <= 0.15 - 0.1 then 0.0 else 0.5 * (1 + cos(pi() * (q - 0.15) / 0.1)) end
    * case when q <= 0.4 then 1.0 when q >= 0.4 + 0.1 then 0.0 else 0.5 * (1 + cos(pi() * (0.4 - q) / 0.1)) end as m
    from (select *, sqrt(ky * ky / 16.0 + kx * kx / 16.0) as q from n, range(-2, 2) as r(ky), range(-2, 2) as t(kx)))
  group by box_id, ky, kx
)"""
    + f" select box_id, yy as y, xx as x, {s6('sum(m * (re * cos(2 * pi() * (ky * yy + kx * xx) / 4) - im * sin(2 * pi() * (ky * yy + kx * xx) / 4)))')} as v from f cross join range(4) as r(yy) cross join range(4) as t(xx) group by box_id, yy, xx"
)
def particle_preparation(spark, sf_dir):
    out = K.prepare_particles(pixels(spark, sf_dir), _boxes(spark, sf_dir), SHAPE, (1, 4, 4), 0.15, 0.4, 0.1)
    return stack_to_pixels(out).select(F.col("image_id").alias("box_id"), "y", "x", r6("v").alias("v"))


@query(PX + " select distinct image_id, cast(image_id % 3 - 1 as double) as sy, cast(image_id % 2 as double) as sx from px")
def alignment(spark, sf_dir):
    left = spectrum(spark, sf_dir)
    i = F.col("image_id")
    moved = stack(spark, sf_dir).select("image_id", F.lit(0.0).alias("sz"), (1.0 - i % 3).alias("sy"), (-(i % 2)).cast("double").alias("sx"))
    found = K.align(left, phase_shift(left, moved, SHAPE), SHAPE)
    return found.select("image_id", (F.round("sy") + 0.0).alias("sy"), (F.round("sx") + 0.0).alias("sx"))


HALVES = RASTER.replace("image_id // 8 as volume_id", "image_id // 8 * 2 + image_id % 2 as volume_id")


@query(
    HALVES
    + """, v as (
  select volume_id // 2 as volume_id, volume_id % 2 as half, kz, ky, kx, case when abs(weight) < 1e-12 then 0 else re / weight end as re, case when abs(weight) < 1e-12 then 0 else im / weight end as im,
    sqrt(kz * kz / 64.0 + ky * ky / 64.0 + kx * kx / 64.0) as f from raster
), z as (
  select a.volume_id, a.f, a.re, a.im, b.re as r_re, b.im as r_im from v a join v b on a.volume_id = b.volume_id and a.kz = b.kz and a.ky = b.ky and a.kx = b.kx and a.half = 0 and b.half = 1 where a.f <= 0.5
), s as (
  select *, cast(floor(f * 8) as bigint) as shell, 1 - (f * 8 - floor(f * 8)) as share from z
  union all select *, least(cast(floor(f * 8) as bigint) + 1, 4), f * 8 - floor(f * 8) from z
), c as (
  select volume_id, shell, sum(share * (re * r_re + im * r_im)) / greatest(1e-6, sqrt(sum(share * (re * re + im * im)) * sum(share * (r_re * r_re + r_im * r_im)))) as fsc from s group by 1, 2
), w as (
  select volume_id, shell, sum(p * share) / sum(share) as power from (
    select volume_id, re * re + im * im as p, cast(floor(f * 8) as bigint) as shell, 1 - (f * 8 - floor(f * 8)) as share from v where half = 0 and f <= 0.5
    union all select volume_id, re * re + im * im, cast(floor(f * 8) as bigint) + 1, f * 8 - floor(f * 8) from v where half = 0 and f <= 0.5 and floor(f * 8) < 4)
  group by 1, 2
)"""
    + f" select volume_id, shell, {s6('fsc')} as fsc, {s6('power')} as power from c left join w using (volume_id, shell)"
)
def reconstruction_resolution(spark, sf_dir):
    out = K.resolution(spectrum(spark, sf_dir), _pose(spark, sf_dir, _turn()), SHAPE, VOLUME, 0.45)
    return out.select("volume_id", "shell", r6("fsc").alias("fsc"), r6("power").alias("power"))


@query(
    SP
    + """, t as (
  select cast(floor(f * 8) as bigint) as shell, 1 - (f * 8 - floor(f * 8)) as share, re * re + im * im as p from fq where f <= 0.5
  union all select cast(floor(f * 8) as bigint) + 1, f * 8 - floor(f * 8), re * re + im * im from fq where f <= 0.5 and floor(f * 8) < 4
)"""
    + f" select shell, {s6('sum(p * share)')} as value, {s6('sum(share)')} as weight from t group by shell"
)
def stream_accumulate_shells(spark, sf_dir):
    """The spectra as a file stream, a part a micro-batch, into running sums."""
    folder = shared_folder(spark)
    spectra = spectrum(spark, sf_dir)
    spectra.repartition(4, "image_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spectra.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    name = f"shells_{uuid.uuid4().hex}"
    running = accumulate_shells(stream, SHAPE).writeStream.outputMode("complete").format("memory").queryName(name)
    run = running.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("shell", r6("value").alias("value"), r6("weight").alias("weight"))


@query(RASTER + f" select volume_id, kz, ky, kx, {s6('re')} as re, {s6('im')} as im, {s6('weight')} as weight from raster")
def stream_accumulate_volume(spark, sf_dir):
    """The spectra as a file stream into rasterized volumes kept by micro-batch."""
    folder = shared_folder(spark)
    spectra, poses = spectrum(spark, sf_dir), _pose(spark, sf_dir, _turn())
    spectra.repartition(4, "image_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spectra.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    sink = VolumeSink(f"{folder}/volume", lambda batch: J.rasterize_central_slices_3d(batch, poses, SHAPE, VOLUME, 0.45))
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    sink.compact(spark)
    out = sink.read(spark)
    return out.select("volume_id", "kz", "ky", "kx", r6("re").alias("re"), r6("im").alias("im"), r6("weight").alias("weight"))
