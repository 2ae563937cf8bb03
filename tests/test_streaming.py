"""Running sums equal the batch job, and a repeated micro-batch changes nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lamina.operators import fourier as T
from lamina.operators.projection import rasterize_central_slices_3d
from lamina.streaming.accumulate import VolumeSink, accumulate_shells

from .test_operators import make

SHAPE = (1, 8, 8)
EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def close(a, b, keys):
    one, two = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (a, b))
    assert one.keys() == two.keys()
    for k in one:
        assert all(np.isclose(one[k][c], two[k][c], atol=1e-12) for c in one[k].asDict() if c not in keys)


def spectra(spark):
    rng = np.random.default_rng(8)
    return T.to_frequencies(T.fft_r2c(make(spark, [rng.normal(size=SHAPE) for _ in range(6)])), SHAPE)


def test_shell_sums(spark, tmp_path):
    whole = spectra(spark).cache()
    whole.repartition(3, "image_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = accumulate_shells(stream, SHAPE).writeStream.outputMode("complete").format("memory").queryName("shell_sums")
    run = run.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    close(spark.table("shell_sums"), accumulate_shells(whole, SHAPE), ["shell"])


def test_volumes_take_each_batch_once(spark, tmp_path):
    whole = spectra(spark).cache()
    poses = whole.select("image_id").distinct().select("image_id", F.lit(0).alias("volume_id"), F.array(*[F.lit(v) for v in EYE]).alias("matrix"))
    rasterize = lambda batch: rasterize_central_slices_3d(batch, poses, SHAPE, (8, 8, 8))
    sink = VolumeSink(f"file://{tmp_path}/volume", rasterize)
    first, second = whole.filter("image_id < 4"), whole.filter("image_id >= 4")
    sink(first, 0)
    sink(second, 1)
    sink(second, 1)  # as after a failure
    keys = ["volume_id", "kz", "ky", "kx"]
    close(sink.read(spark), rasterize(whole), keys)


def test_compaction_may_stop_anywhere(spark, tmp_path):
    values = lambda k: spark.createDataFrame([(0, 0, 0, k, 1.0 + k, 2.0, 1.0), (0, 0, 0, 9, float(k), 0.0, 1.0)], "volume_id int, kz long, ky long, kx long, re double, im double, weight double")
    sink = VolumeSink(str(tmp_path / "v"), lambda batch: batch)
    total = lambda: {r["kx"]: (r["re"], r["weight"]) for r in sink.read(spark).collect()}
    parts = lambda: sorted(p.name for p in (tmp_path / "v").iterdir())
    want = lambda n: {**{k: (1.0 + k, 1.0) for k in range(n)}, 9: (float(sum(range(n))), float(n))}
    for k in range(3):
        sink(values(k), k)
    sink.compact(spark)
    assert total() == want(3) and [p for p in parts() if p.startswith("sum")] == ["sum=000000000002"]
    assert len(parts()) == 4  # readers may still hold what was summed
    sink(values(2), 2)  # a batch below the sum runs again
    assert total() == want(3)
    sink(values(3), 3)
    whole = tmp_path / "v" / "sum=000000000003"
    whole.mkdir()
    (whole / "part-0.parquet").write_bytes(b"half")  # stopped within the next sum
    (tmp_path / "v" / "batch=000000000009").mkdir()  # and within a batch
    assert total() == want(4)
    sink.compact(spark)
    assert total() == want(4)
    assert parts() == ["batch=000000000003", "batch=000000000009", "sum=000000000002", "sum=000000000003"]
    sink.compact(spark)  # nothing is new
    sink(values(4), 4)
    sink.compact(spark)
    assert total() == want(5) and "sum=000000000002" not in parts() and "sum=000000000004" in parts()
