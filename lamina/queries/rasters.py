"""Queries on images that are summed from large tables: lineitem as rasters of days by quantities, events as hourly signals."""

from __future__ import annotations

import datetime
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import power
from ..model import AXES, Shape, grid
from ..operators import fourier as T
from ..operators import neighbourhoods as N
from ..operators import reductions as R
from ..operators.reshape import pixels_to_stack, stack_to_pixels
from .base import ORACLE_SQL, query, r6, s6

RASTER: Shape = (1, 366, 50)


def filled(pixels: DataFrame, shape: Shape) -> DataFrame:
    """Every element of every image, 0 where there was none."""
    whole = grid(pixels.select("image_id").distinct(), shape)
    return whole.join(pixels, ["image_id", *AXES], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def rasters(spark, sf_dir) -> DataFrame:
    """lineitem as an image for each return flag and year: price by day of the year and quantity. Sparse; the
    sums are combined before the shuffle, so a table of any length costs one row a task and pixel."""
    held = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice").dropna()
    at = held.select(
        (F.ascii("l_returnflag") * 10000 + F.year("l_shipdate")).cast("long").alias("image_id"), F.lit(0).cast("long").alias("z"),
        (F.dayofyear("l_shipdate") - 1).cast("long").alias("y"), (F.floor("l_quantity") - 1).cast("long").alias("x"), "l_extendedprice",
    )
    return at.filter(F.col("x").between(0, RASTER[2] - 1)).groupBy("image_id", *AXES).agg(F.sum("l_extendedprice").alias("v"))


RX = """with rx as (
  select image_id, y, x, sum(l_extendedprice) as v
  from (select cast(ascii(l_returnflag) * 10000 + year(l_shipdate) as bigint) as image_id, cast(dayofyear(l_shipdate) - 1 as bigint) as y,
    cast(floor(l_quantity) - 1 as bigint) as x, l_extendedprice from lineitem
    where l_returnflag is not null and l_shipdate is not null and l_quantity is not null and l_extendedprice is not null)
  where x between 0 and 49 group by all
), ax as (
  select image_id, y, x, coalesce(v, 0) as v
  from (select distinct image_id from rx) cross join (select range as y from range(366)) cross join (select range as x from range(50)) left join rx using (image_id, y, x)
)"""


@query(RX + f""" select image_id, {s6('min(v)')} as lowest, {s6('max(v)')} as highest, {s6('sum(v)')} as total, {s6('avg(v)')} as mean,
  {s6('var_pop(v)')} as variance, {s6('sqrt(sum(v * v))')} as norm, {s6('median(v)')} as middle from (select image_id, v / 10000 as v from ax) group by image_id""")
def raster_statistics(spark, sf_dir):
    """In 10,000s: cents are whole in six places, so sums have no ties in rounding."""
    pixels = filled(rasters(spark, sf_dir), RASTER).withColumn("v", F.col("v") / 10000)
    found = R.reduce(pixels, ["image_id"], "min", "max", "sum", "mean", "variance", "l2_norm", "median")
    names = {"min": "lowest", "max": "highest", "sum": "total", "mean": "mean", "variance": "variance", "l2_norm": "norm", "median": "middle"}
    return found.select("image_id", *[r6(c).alias(n) for c, n in names.items()])


@query(RX + f"""
select image_id, y - dy as y, x - dx as x, {s6('sum(v * ky * kx / 16)')} as v
from rx cross join (values (-1, 1), (0, 2), (1, 1)) as a(dy, ky) cross join (values (-1, 1), (0, 2), (1, 1)) as b(dx, kx)
where y - dy between 0 and 365 and x - dx between 0 and 49 group by all""")
def raster_convolve(spark, sf_dir):
    """What the sparse pixels reach; the rest is 0."""
    kernel = [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]]
    out = N.convolve(rasters(spark, sf_dir), RASTER, np.array(kernel))
    return out.select("image_id", "y", "x", r6("v").alias("v"))


@query(RX + f""", t as (
  select image_id, y, x, case when y + dy = 366 then 364 else abs(y + dy) end as by, case when x + dx = 50 then 48 else abs(x + dx) end as bx
  from ax cross join (values (-1), (0), (1)) as r(dy) cross join (values (-1), (0), (1)) as s(dx)
), m as (
  select t.image_id, t.y, t.x, list_sort(list(b.v))[5] as v from t join ax b on b.image_id = t.image_id and b.y = t.by and b.x = t.bx group by 1, 2, 3
) select image_id, y, x, {s6('v')} as v from m""")
def raster_median(spark, sf_dir):
    """Within the rows of the images."""
    out = N.median_filter_dense(pixels_to_stack(rasters(spark, sf_dir), RASTER), (1, 3, 3))
    return stack_to_pixels(out).select("image_id", "y", "x", r6("v").alias("v"))


@query(ORACLE_SQL["raster_median"])
def raster_median_tiled(spark, sf_dir):
    """The same by tiles with halos, which take images of any size."""
    return N.median_filter(filled(rasters(spark, sf_dir), RASTER), RASTER, (1, 3, 3)).select("image_id", "y", "x", r6("v").alias("v"))


def signals(spark, sf_dir) -> tuple[DataFrame, Shape]:
    """events as one line an user: the sum of values in each hour from the table's first day to its last hour (sparse), with
    the length of the lines."""
    held = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value").dropna()
    first, last = held.agg(F.to_date(F.min("ts")), F.max(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) * 24 + F.hour("ts"))).first()
    if first is None:
        return held.select(F.col("user_id").cast("long").alias("image_id"), *[F.lit(0).cast("long").alias(a) for a in AXES], F.col("value").alias("v")), (1, 1, 1)
    hour = F.datediff(F.to_date("ts"), F.lit(first)) * 24 + F.hour("ts")
    at = held.select(F.col("user_id").cast("long").alias("image_id"), F.lit(0).cast("long").alias("z"), F.lit(0).cast("long").alias("y"), hour.cast("long").alias("x"), "value")
    n = last - (first - datetime.date(1970, 1, 1)).days * 24 + 1
    return at.groupBy("image_id", *AXES).agg(F.sum("value").cast("double").alias("v")), (1, 1, n)


SX = """with held as (
  select cast(user_id as bigint) as image_id, date_diff('day', (select min(ts)::date from events where user_id is not null and value is not null), ts::date) * 24 + hour(ts) as x, value
  from events where user_id is not null and ts is not null and value is not null
), sx as (select image_id, x, cast(sum(value) as double) as v from held group by all), len as (select max(x) + 1 as n from sx)"""


@query(SX + f""", ax as (
  select image_id, x, coalesce(v, 0) as v from (select distinct image_id from sx) cross join (select unnest(range(n)) as x from len) left join sx using (image_id, x)
), c as (
  select image_id, x, 0.25 * coalesce(lag(v) over w, 0) + 0.5 * v + 0.25 * coalesce(lead(v) over w, 0) as v from ax window w as (partition by image_id order by x)
) select image_id, x, {s6('v')} as v from c""")
def signal_smoothing(spark, sf_dir):
    lines, shape = signals(spark, sf_dir)
    out = N.convolve_separable(filled(lines, shape), {"x": [0.25, 0.5, 0.25]})
    return out.select("image_id", "x", r6("v").alias("v"))


@query(SX + f""", p as (
  select image_id, k, sum(v * cos({2 * math.pi} * k * x / n)) / max(n) as re, sum(v * sin({2 * math.pi} * k * x / n)) / max(n) as im
  from sx cross join len cross join (select unnest(range(n // 2 + 1)) as k from len) group by image_id, k
) select image_id, k as kx, {s6('re * re + im * im')} as v from p""")
def signal_power(spark, sf_dir):
    """Power spectra of whole months of hours, one line a row."""
    lines, shape = signals(spark, sf_dir)
    spectra = T.to_frequencies(T.fft_r2c(pixels_to_stack(lines, shape)), shape)
    return spectra.select("image_id", "kx", r6(power(F.col("re"), F.col("im"))).alias("v"))


@query(ORACLE_SQL["signal_power"])
def signal_power_factored(spark, sf_dir):
    """The same for lines of any length: two short transforms and a shuffle between."""
    lines, shape = signals(spark, sf_dir)
    return T.dft_factored(lines, shape).select("image_id", "kx", r6(power(F.col("re"), F.col("im"))).alias("v"))


@query("select l_returnflag as flag, median(l_extendedprice) as middle from lineitem group by l_returnflag")
def median_selected(spark, sf_dir):
    """Medians of groups that hold a large part of the table, by rounds of bounded sketches and counts."""
    prices = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"))
    return R.median_selected(prices, ["flag"]).select("flag", F.col("median").alias("middle"))
