"""The three usual jobs, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Shape
from ..operators import correlation as X
from ..operators import fourier as T
from ..operators import projection as J
from ..operators import reductions as R
from ..operators import shells as H
from ..operators import spectra as P
from ..operators import subregions as B
from ..operators.reshape import pixels_to_stack, stack_to_pixels


def prepare_particles(pixels: DataFrame, boxes: DataFrame, shape: Shape, box: Shape, first: float, last: float, width: float) -> DataFrame:
    """Boxes cut out of images, normalized and band-passed: a stack whose image_id is the box_id.

    One join to cut, one grouping to make each box a row; all else stays in the row."""
    cut = B.extract_subregions(pixels, boxes, shape, box)
    stack = pixels_to_stack(cut.drop("image_id").withColumnRenamed("box_id", "image_id"), box)
    spectra = T.to_frequencies(T.fft_r2c(R.normalize_dense(stack, "mean_std")), box)
    filtered = P.bandpass(spectra, box, first, last, width, width)
    return T.fft_c2r(T.from_frequencies(filtered, box))


def align(left: DataFrame, right: DataFrame, shape: Shape, mode: str = "conventional") -> DataFrame:
    """image_id, sy, sx: how far each image of right must move to match left's image of the same id."""
    product = X.correlation_spectrum(X.zip_spectra(left, right), mode)
    maps = X.centered(stack_to_pixels(T.fft_c2r(T.from_frequencies(product, shape))), shape)
    found = X.peak(maps, shape)
    half = 0.5 if mode == "double_phase" else 1.0
    return found.select(
        "image_id", F.lit(0.0).alias("sz"), ((F.col("y") - shape[1] // 2) * half).alias("sy"), ((F.col("x") - shape[2] // 2) * half).alias("sx"), "value"
    )


def reconstruct(spectrum: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, cutoff: float = 0.5) -> DataFrame:
    """Half spectra of volumes from slices and their rotations: volume_id, kz, ky, kx, re, im."""
    return J.weight_corrected(J.rasterize_central_slices_3d(spectrum, poses, shape, volume, cutoff)).drop("weight")


def resolution(spectrum: DataFrame, poses: DataFrame, shape: Shape, volume: Shape, cutoff: float = 0.5) -> DataFrame:
    """volume_id, shell, fsc, power: the correlation of two half reconstructions (images of even and odd id) and the first
    one's power per shell."""
    halves = [
        reconstruct(spectrum.filter(F.col("image_id") % 2 == k), poses.filter(F.col("image_id") % 2 == k), shape, volume, cutoff).withColumnRenamed("volume_id", "image_id")
        for k in (0, 1)
    ]
    fsc = X.fsc_isotropic(X.zip_spectra(*halves), volume).withColumnRenamed("value", "fsc")
    power = H.rotational_average(halves[0], volume).select("image_id", "shell", F.col("value").alias("power"))
    return fsc.join(power, ["image_id", "shell"], "left").withColumnRenamed("image_id", "volume_id")
