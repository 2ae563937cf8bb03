"""Projections by blocks of poses against the joins of elements."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import geometry as M
from lamina.operators import projection as J

VOLUME, SHAPE = (5, 9, 7), (1, 11, 8)


def values(spark, shape, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(k, *map(int, i), float(rng.normal())) for k in range(n) for i in np.ndindex(shape)]
    return spark.createDataFrame(rows, "image_id long, z long, y long, x long, v double")


def posed(spark, n, volumes, seed):
    rng = np.random.default_rng(seed)
    rows = [(k, k % volumes, *a) for k, a in enumerate(rng.uniform(-2, 2, size=(n, 3)).tolist())] + [(1, volumes - 1, 0.0, 0.0, 0.0), (2, 7, 0.5, 0.0, 0.0), (3, None, 0.0, 0.0, 0.0)]
    i = spark.createDataFrame(rows, "image_id long, volume_id long, a double, b double, c double")
    turn = M.about(M.euler_matrix((F.col("a"), F.col("b"), F.col("c"))), [2.0, 4.0, 3.0], [F.lit(0.25), F.lit(0.5), F.lit(1.0)])
    return [i.select("image_id", "volume_id", M.flattened(m).alias("matrix")) for m in (turn[1:], turn)]


def held(df):
    return {(r["image_id"], r["y"], r["x"]): r["v"] for r in df.collect()}


@pytest.mark.parametrize("kernel,tile_pixels,block", [("linear", 1 << 14, 64), ("linear", 12, 2), ("nearest", 12, 64), ("cubic", 20, 64)])
def test_in_and_out_by_blocks(spark, monkeypatch, kernel, tile_pixels, block):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "PART_IMAGES", 2 if block == 2 else 1 << 12)
    pixels = values(spark, SHAPE, 6, 1).filter("not (image_id = 0 and y = 4 and x between 2 and 5)")
    pixels = pixels.unionByName(pixels.filter("image_id = 1 and y = 3"))  # an element given twice counts twice
    inputs, outputs = posed(spark, 7, 2, 2)
    want = held(J.backward_and_forward_project_3d_joined(pixels, inputs, outputs, SHAPE, VOLUME, 7, kernel))
    got = held(J.backward_and_forward_project_3d(pixels, inputs, outputs, SHAPE, VOLUME, 7, kernel, tile_pixels))
    assert want and got.keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_no_row_is_made_for_a_point(spark):
    inputs, outputs = posed(spark, 4, 1, 3)
    pixels = values(spark, SHAPE, 4, 4)
    assert J.backward_and_forward_project_3d(pixels, inputs.filter("false"), outputs, SHAPE, VOLUME).count() == 0
    plan = J.backward_and_forward_project_3d(pixels, inputs, outputs, SHAPE, VOLUME)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "explode(array(struct(" not in plan


@pytest.mark.parametrize("kernel,brick,block", [("linear", 32, 64), ("linear", 3, 2), ("nearest", 3, 64), ("cubic", 4, 64)])
def test_rays_through_bricks(spark, monkeypatch, kernel, brick, block):
    monkeypatch.setattr(J, "BLOCK", block)
    voxels = values(spark, VOLUME, 2, 5).filter("not (image_id = 1 and z = 2)")
    voxels = voxels.unionByName(voxels.filter("image_id = 0 and z = 1 and y = 3"))
    _, poses = posed(spark, 7, 2, 6)
    poses = poses.unionByName(spark.createDataFrame([(20, 0, [0.0] * 12), (21, 1, [0.0, 1.0, 0.0, 0.0] + [1.0, 0.0, 0.0, 2.5] + [0.0, 0.0, 1.0, -0.5])], poses.schema))
    for window in (7, None):
        want = held(J.forward_project_3d_joined(voxels, poses, SHAPE, VOLUME, window, kernel))
        got = held(J.forward_project_3d(voxels, poses, SHAPE, VOLUME, window, kernel, 0, brick))
        assert want and got.keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    assert J.forward_project_3d(voxels, poses.filter("false"), SHAPE, VOLUME, most_sent=0).count() == 0


def test_more_than_a_little_is_not_sent(spark):
    _, poses = posed(spark, 4, 1, 7)
    many = values(spark, (2, 2, 2), 1, 8).crossJoin(spark.range(20_000).select(F.col("id").alias("_k"))).withColumn("image_id", F.col("_k")).drop("_k")
    plan = J.forward_project_3d(many, poses, (1, 2, 2), (2, 2, 2))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "explode(array(struct(" not in plan


def test_poses_without_a_matrix_project_nothing(spark):
    inputs, outputs = posed(spark, 4, 1, 9)
    pixels = values(spark, SHAPE, 4, 10)
    want = held(J.backward_and_forward_project_3d(pixels, inputs, outputs, SHAPE, VOLUME))
    more = lambda df: df.unionByName(df.limit(1).withColumns({"image_id": F.lit(3).cast("long"), "matrix": F.lit(None).cast("array<double>")}))
    got = held(J.backward_and_forward_project_3d(pixels, more(inputs), more(outputs), SHAPE, VOLUME))
    assert want and got.keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


SLICE, GRID, TARGET, RADIUS = (1, 9, 10), (7, 6, 8), (9, 8, 10), (1.3, 0.9)


def slices(spark, weighted):
    """Half spectra without the third image and a part of the second, poses of four images in two volumes and one by itself."""
    rng = np.random.default_rng(11)
    rows = [(i, 0, ky, kx, *map(float, rng.normal(size=2)), float(rng.uniform(0.5, 2))) for i in (0, 1, 3) for ky in range(-4, 5) for kx in range(6) if i != 1 or ky < 2]
    spectrum = spark.createDataFrame(rows, "image_id long, kz long, ky long, kx long, re double, im double, weight double")
    turns = [(k, k % 2, *a) for k, a in enumerate(rng.uniform(-2, 2, size=(4, 2)).tolist())] + [(0, 1, 0.4, 0.2), (1, 5, 0.0, 0.0), (2, None, 0.0, 0.0)]
    i = spark.createDataFrame(turns, "image_id long, volume_id long, a double, b double")
    turn = M.euler_matrix((F.col("a"), F.col("b"), F.lit(0.3)))
    ways = [turn, [[turn[c][r] for c in range(3)] for r in range(3)]]
    forward, inverse = (i.select("image_id", "volume_id", M.flattened(m).alias("matrix"), F.array(F.lit(1.04), F.lit(0.03), F.lit(-0.02), F.lit(0.95)).alias("scaling")) for m in ways)
    return spectrum if weighted else spectrum.drop("weight"), inverse, forward


def same(got, want, keys):
    got, want = ({tuple(r[k] for k in keys): (r["re"], r["im"], r["weight"]) for r in df.collect()} for df in (got, want))
    assert want and got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))


@pytest.mark.parametrize("weighted,brick,tile_pixels", [(True, 32, 1 << 14), (False, 3, 9), (True, 3, 9)])
def test_slices_near_voxels_by_tiles(spark, monkeypatch, weighted, brick, tile_pixels):
    monkeypatch.setattr(J, "PART_IMAGES", 2 if brick == 3 else 1 << 12)
    spectrum, inverse, _ = slices(spark, weighted)
    for poses in (inverse, inverse.drop("scaling")):
        given = spectrum, poses, SLICE, GRID, 0.12, 0.2, 0.43, RADIUS, TARGET
        same(J.insert_central_slices_3d(*given, brick, tile_pixels), J.insert_central_slices_3d_joined(*given), ("volume_id", "kz", "ky", "kx"))
    plan = J.insert_central_slices_3d(*given)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "explode(array(struct(" not in plan


@pytest.mark.parametrize("weighted,block,tile_pixels,depth", [(True, 64, 1 << 14, (0.15, 0.3)), (False, 2, 9, (0.15, 0.3)), (False, 64, 9, (0.0, 0.0))])
def test_slices_near_slices_by_tiles(spark, monkeypatch, weighted, block, tile_pixels, depth):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "PART_IMAGES", 2 if block == 2 else 1 << 12)
    monkeypatch.setattr(J, "POINTS", 100 if block == 2 else 1 << 17)
    spectrum, inverse, forward = slices(spark, weighted)
    points = J._slice_points(forward, SLICE, RADIUS, depth, 9, 0.43)
    want = J.slices_at(points, spectrum, inverse, ["out_id", "ky", "kx"], SLICE, *J._least((0.12, 0.2), 9), RADIUS)
    got = J.insert_and_extract_central_slices_3d(spectrum, inverse, forward, SLICE, 0.12, 0.2, 0.43, ews_radius=RADIUS, depth_window=depth, tile_pixels=tile_pixels)
    same(got, want, ("out_id", "ky", "kx"))


def test_a_full_batch_of_small_images_is_taken_in_pieces():
    import pyarrow as pa

    from lamina.operators.dense import pieces

    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros((10_000, 64)).tolist(), pa.list_(pa.float64()))], ["values"])
    sizes = [len(p) for p in pieces(iter([batch]))]
    assert sum(sizes) == 10_000 and max(sizes) <= 1024
