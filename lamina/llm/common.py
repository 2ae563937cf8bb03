"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the size and quality rules: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: of spark.checkpoint.dir, or of the checkpoint directory that was set. A local
    session without either (tests) gets a temporary one; a cluster's executors would not see that, so there it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_WRITTEN: dict[str, SparkSession] = {}
_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def forget(*frames: DataFrame) -> None:
    """Remove the files of frames that `cut` returned (without any: of all of them), which nothing may read any more."""
    for path in [_PATH_OF[f] for f in frames] if frames else list(_WRITTEN):
        spark = _WRITTEN.pop(path, None)
        if spark is not None and spark.sparkContext._jsc is not None:
            _remove(spark, path)


atexit.register(forget)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and never the work before it, and stops a
    frame that several branches use from being computed once for each. The files go when the driver ends, or at `forget`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[path] = spark
    _PATH_OF[out] = path
    return out


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut (without a copy) so that a piece's texts have about `limit` bytes, one row at least: a task
    holds the Python objects of one piece, however large Spark's batches are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        for n in np.unique(np.cumsum(sizes, dtype=np.int64) // limit, return_counts=True)[1].tolist():
            yield batch.slice(at, n)
            at += n


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on, so that other columns never clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
