"""Shell averages of spectra, and spectra aligned by their CTF's phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ctf as C
from ..functions.elementwise import EPSILON
from ..model import Shape, exploded, fftfreq, norm_fftfreq


def _spread(f: Column, n_shells: int, first: float, last: float) -> Column:
    """(shell, share) pairs of a frequency between the shells evenly on [first, last]; outside none."""
    place = (f - first) * (n_shells - 1) / (last - first)
    low = F.floor(place).cast("long")
    part = place - low
    pairs = F.array(F.struct(low.alias("shell"), (1 - part).alias("share")), F.struct((low + 1).alias("shell"), part.alias("share")))
    kept = F.filter(pairs, lambda p: (p["shell"] >= 0) & (p["shell"] < n_shells))
    return F.when((place >= 0) & (f <= last), kept).otherwise(F.filter(pairs, lambda p: F.lit(False)))


def divide_safe(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) < EPSILON, 0.0).otherwise(F.try_divide(a, b))


def _sum_shells(rows: DataFrame, keys: list[str], value: Column, f: Column, n_shells: int, first: float, last: float, average: bool) -> DataFrame:
    each = exploded(rows.select(*keys, value.alias("_v"), F.explode(_spread(f, n_shells, first, last)).alias("_s")))
    sums = each.groupBy(*keys, F.col("_s.shell").alias("shell")).agg(
        F.sum(F.col("_v") * F.col("_s.share")).alias("value"), F.sum(F.col("_s.share")).alias("weight")
    )
    return sums.withColumn("value", divide_safe(F.col("value"), F.col("weight"))) if average else sums


def rotational_average(spectrum: DataFrame, shape: Shape, n_shells: int | None = None, first: float = 0.0, last: float = 0.5, average: bool = True, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, shell, value, weight: the power of each shell, split linearly between its two nearest shells. Stored rows
    count once, whatever the layout. Two rows per frequency, summed before the shuffle."""
    n_shells = n_shells or min(v for v in shape if v > 1) // 2 + 1
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return _sum_shells(spectrum, list(keys), power, norm_fftfreq(shape), n_shells, first, last, average)


def rotational_average_anisotropic(spectrum: DataFrame, ctfs: DataFrame, shape: Shape, n_shells: int | None = None, first: float = 0.0, last: float = 0.5, average: bool = True) -> DataFrame:
    """The same with each frequency corrected for its image's anisotropic pixel and defocus."""
    n_shells = n_shells or min(v for v in shape if v > 1) // 2 + 1
    f = fftfreq(shape)
    joined = spectrum.join(C.params(ctfs), "image_id")
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return _sum_shells(joined, ["image_id"], power, C.isotropic_fftfreq(f["ky"], f["kx"]), n_shells, first, last, average)


def _shell_fftfreq(shell: Column, n_shells: int, first: float, last: float) -> Column:
    return first + shell * (last - first) / (n_shells - 1)


def _renamed(ctfs: DataFrame, prefix: str) -> DataFrame:
    return ctfs.select(*[F.col(c).alias(f"{prefix}{c}") for c in ctfs.columns])


def fuse_spectra(shells: DataFrame, ctfs: DataFrame, target: DataFrame, n_shells: int, first: float, last: float, average: bool = True) -> DataFrame:
    """1-d spectra moved to the frequencies at which the target's CTF has their phase, and summed or averaged per chunk.

    shells: image_id, chunk, shell, value; ctfs: one row per image_id; target: one row per chunk (keyed `chunk`)."""
    source = shells.join(C.params(ctfs), "image_id")
    r = _shell_fftfreq(F.col("shell"), n_shells, first, last) / F.col("pixel_size")
    with_phase = source.select("chunk", "value", C.phase(r * r).alias("_phase"), F.col("scale").alias("_scale"))
    aimed = with_phase.join(C.params(target), "chunk")
    f = C.phase_inverse(F.col("_phase")) * F.col("pixel_size")
    each = exploded(aimed.select("chunk", (F.col("value") * F.col("_scale")).alias("_v"), F.col("_scale"), F.explode(_spread(f, n_shells, first, last)).alias("_s")))
    sums = each.groupBy("chunk", F.col("_s.shell").alias("shell")).agg(
        F.sum(F.col("_v") * F.col("_s.share")).alias("value"), F.sum(F.col("_scale") * F.col("_s.share")).alias("weight")
    )
    return sums.withColumn("value", divide_safe(F.col("value"), F.col("weight"))) if average else sums


def phase_spectra(shells: DataFrame, ctfs: DataFrame, target: DataFrame, n_shells: int, first: float, last: float) -> DataFrame:
    """Each image's 1-d spectrum resampled on the target's shells: for a target shell, the input frequency of equal
    phase, interpolated linearly; 0 outside. target: one CTF per image_id."""
    images = shells.select("image_id").distinct()
    grid = exploded(images.withColumn("shell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shells - 1).cast("long")))))
    aimed = grid.join(C.params(target), "image_id")
    r = _shell_fftfreq(F.col("shell"), n_shells, first, last) / F.col("pixel_size")
    asked = aimed.select("image_id", "shell", C.phase(r * r).alias("_phase")).join(C.params(ctfs), "image_id")
    f = C.phase_inverse(F.col("_phase")) * F.col("pixel_size")
    taps = exploded(asked.select("image_id", "shell", F.explode(_spread(f, n_shells, first, last)).alias("_s")))
    source = shells.select("image_id", F.col("shell").alias("_source"), "value")
    got = taps.withColumn("_source", F.col("_s.shell")).join(source, ["image_id", "_source"])
    sums = got.groupBy("image_id", "shell").agg(F.sum(F.col("value") * F.col("_s.share")).alias("value"))
    return grid.join(sums, ["image_id", "shell"], "left").select("image_id", "shell", F.coalesce("value", F.lit(0.0)).alias("value"))
