"""Reading and writing stacks as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import metadata


def as_stack(df: DataFrame, image_id: str, values: str, shape: tuple[int, int, int], keep: tuple[str, ...] = ()) -> DataFrame:
    """A table with one array per image as a stack; rows without values are dropped."""
    d, h, w = shape
    return df.filter(F.col(values).isNotNull()).select(
        F.col(image_id).cast("long").alias("image_id"),
        *[F.lit(n).cast("int").alias(c) for c, n in zip("dhw", shape, strict=True)],
        F.col(values).cast("array<double>").alias("values"),
        *keep,
    )


def read_stack(spark: SparkSession, path: str, enforce_2d: bool = False) -> DataFrame:
    """A stored stack; enforce_2d turns each volume into its planes, numbered by z."""
    stack = spark.read.parquet(path)
    return planes(stack) if enforce_2d else stack


def planes(stack: DataFrame) -> DataFrame:
    """Each image's planes as 2-d images: image_id becomes z, the volume's id stays as volume_id."""
    size = F.col("h") * F.col("w")
    cut = F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda z: F.slice("values", z * size + 1, size))
    others = metadata(stack, "image_id", "d", "h", "w", "values")
    return stack.select(
        F.col("image_id").alias("volume_id"), "h", "w", *others, F.posexplode(cut).alias("z", "values")
    ).select("volume_id", F.col("z").cast("long").alias("image_id"), F.lit(1).alias("d"), "h", "w", "values", *others)


def read_slices(stack: DataFrame, first: int, n: int, first_plane: int = 0, n_planes: int | None = None) -> DataFrame:
    """Consecutive images first .. first + n - 1, and of each the planes asked for. The id filter reaches the scan."""
    part = stack.filter(F.col("image_id").between(first, first + n - 1))
    if n_planes is None and not first_plane:
        return part
    size = F.col("h") * F.col("w")
    n_planes_col = F.col("d") - first_plane if n_planes is None else F.lit(n_planes)
    return part.withColumns(
        {"values": F.slice("values", first_plane * size + 1, n_planes_col * size), "d": n_planes_col.cast("int")}
    )


def statistics(stack: DataFrame) -> DataFrame:
    """min, max, mean and (population) stddev of each image, kept with it."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a, v):  # one pass, stable; refers to nothing outside the fold
        n = a["n"] + 1
        mean = a["mean"] + (v - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + (v - a["mean"]) * (v - mean)).alias("m2"))

    folded = stack.withColumn("_s", F.aggregate("values", zero, step))
    return folded.withColumns(
        {
            "min": F.array_min("values"),
            "max": F.array_max("values"),
            "mean": F.col("_s.mean"),
            "stddev": F.sqrt(F.try_divide(F.col("_s.m2"), F.col("_s.n"))),
        }
    ).drop("_s")


def write_stack(stack: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """The stack with its statistics as Parquet."""
    statistics(stack).write.mode(mode).partitionBy(*partition_by).parquet(path)
