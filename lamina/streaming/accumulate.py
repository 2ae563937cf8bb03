"""Running sums over streams of images."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Shape
from ..operators.shells import rotational_average


def accumulate_shells(spectra: DataFrame, shape: Shape, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, shell, value, weight: running shell sums of a (streaming) spectrum table. The state is one row per shell, and
    the result equals the batch job's over all images so far; write it with outputMode("complete") or "update"."""
    return rotational_average(spectra, shape, average=False, keys=keys)


VOLUME = ["volume_id", "kz", "ky", "kx"]
SUMS = ["re", "im", "weight"]


BATCH, SUM = "batch", "sum"


class VolumeSink:
    """foreachBatch writer that keeps rasterized volumes under a folder, one part per micro-batch, and folds parts into sums.

    A batch overwrites its own part, so a batch that is run again after a failure changes nothing. `compact` writes the sum of
    all batches up to the last one as a part of its own, named by that batch: the newest whole sum and the batches after it are the
    volume. A part counts once Spark has marked it as whole (_SUCCESS, written last), so a reader sees all of a part or none of it, and
    a compaction may stop between any two steps and run again. What a sum has replaced is removed by the compaction
    after it, as readers may still hold it; a batch that runs again below a sum is not counted twice.
    """

    def __init__(self, folder: str, rasterize):
        self.folder = folder
        self.rasterize = rasterize

    def part(self, batch_id: int, kind: str = BATCH) -> str:
        return posixpath.join(self.folder, f"{kind}={batch_id:012d}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.rasterize(batch).select(*VOLUME, *SUMS).write.mode("overwrite").parquet(self.part(batch_id))

    def _store(self, spark):
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _parts(self, spark, kind: str) -> list[int]:
        """Batches of the whole parts of a kind, in order. Names alone are read."""
        store, path = self._store(spark)
        found = store.globStatus(path(posixpath.join(self.folder, f"{kind}=*", "_SUCCESS"))) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def live(self, spark, last: int | None = None) -> list[str]:
        """The parts that make up the volume (of the batches up to `last`)."""
        within = lambda kind: [k for k in self._parts(spark, kind) if last is None or k <= last]
        sums = within(SUM)[-1:]
        return [self.part(k, SUM) for k in sums] + [self.part(k) for k in within(BATCH) if not sums or k > sums[0]]

    def read(self, spark) -> DataFrame:
        return self._summed(spark.read.parquet(*self.live(spark)))

    @staticmethod
    def _summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*VOLUME).agg(*[F.sum(c).alias(c) for c in SUMS])

    def compact(self, spark) -> None:
        """Fold all whole parts into one sum. Runs beside a stream: batches that come meanwhile stay parts of their own."""
        batches, sums = self._parts(spark, BATCH), self._parts(spark, SUM)
        newest = sums[-1] if sums else -1
        if not batches or batches[-1] <= newest:
            return
        self._summed(spark.read.parquet(*self.live(spark, batches[-1]))).write.mode("overwrite").parquet(self.part(batches[-1], SUM))
        store, path = self._store(spark)
        for kind, ids, kept in ((BATCH, batches, newest + 1), (SUM, sums, newest)):
            for k in ids:
                if k < kept:
                    store.delete(path(self.part(k, kind)), True)
