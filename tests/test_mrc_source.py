"""The MRC data source against whole files, and files written by many tasks."""

from __future__ import annotations

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from lamina.sources import mrc, mrc_source

from .test_operators import make

RNG = np.random.default_rng(5)


def whole(folder):
    """file name and image -> values, by decoding whole files."""
    out = {}
    for path in folder.rglob("[a-z]*.mrc"):
        for k, values in enumerate(mrc.decode(path.read_bytes())[2]):
            out[path.name, k] = values.tolist()
    return out


def found(df):
    rows = df.collect()
    out = {(r["file"].split("/")[-1], r["image_id"]): list(r["values"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture
def files(tmp_path):
    (tmp_path / "deep").mkdir()
    for name, shape, n, dtype in [("a.mrc", (3, 4, 5), 7, "int16"), ("b.mrc", (1, 4, 5), 40, "float32"), ("deep/c.mrc", (3, 2, 5), 6, "uint4"), ("d.mrc", (2, 2, 3), 4, "float16"), ("empty.mrc", (1, 2, 2), 0, "int8")]:
        (tmp_path / name).write_bytes(mrc.encode(RNG.integers(0, 15, size=(n, int(np.prod(shape)))).astype(float), shape, (1.0, 1.0, 1.0), dtype))
    (tmp_path / "_hidden.mrc").write_bytes(b"none")
    (tmp_path / "notes.txt").write_bytes(b"none")
    return tmp_path


@pytest.mark.parametrize("split", [1 << 27, 900, 64, 1])
def test_any_split_reads_each_image_once(spark, files, split):
    mrc_source.register(spark)
    if split == 1:  # a range for each byte: of one small file
        small = files / "d.mrc"
        assert found(spark.read.format("mrc").option("split", 7).load(str(small))) == {k: v for k, v in whole(files).items() if k[0] == "d.mrc"}
        return
    assert found(spark.read.format("mrc").option("split", split).load(f"file://{files}")) == whole(files)


def test_slices(spark, files):
    mrc_source.register(spark)
    read = spark.read.format("mrc").option("first_plane", 1).option("n_planes", 1).option("split", 500).load(str(files))
    want = {}
    for path in files.rglob("[acd].mrc"):
        (_, d, h, w), _, values = mrc.decode(path.read_bytes())
        want |= {(path.name, k): v.reshape(d, h * w)[1].tolist() for k, v in enumerate(values)}
    rows = read.filter("image_id between 2 and 4").collect()
    assert {(r["file"].split("/")[-1], r["image_id"]): list(r["values"]) for r in rows if r["d"]} == {k: v for k, v in want.items() if 2 <= k[1] <= 4}
    assert all(list(r["values"]) == [] for r in rows if not r["d"])  # b.mrc has no second plane
    same = lambda df, test: found(df) == {k: v for k, v in whole(files).items() if test(*k)}
    everything = spark.read.format("mrc").option("split", 700).load(str(files))
    assert same(everything.filter(F.col("image_id").isin(0, 3, 39)), lambda f, k: k in (0, 3, 39))
    assert same(everything.filter("image_id > 2 and image_id < 30 and image_id <> 7"), lambda f, k: 2 < k < 30 and k != 7)
    assert same(everything.filter(F.col("file") == f"{files}/b.mrc").filter("image_id = 5"), lambda f, k: f == "b.mrc" and k == 5)
    assert same(everything.filter("image_id = 3 and image_id = 4"), lambda f, k: False)
    assert same(everything.filter("image_id is null"), lambda f, k: False)


def test_only_the_asked_bytes_are_read(files, monkeypatch):
    """Counted at the reader: headers, and the planes of the images in range."""
    options = {"path": str(files), "first_plane": "1", "n_planes": "1"}
    from pyspark.sql.datasource import GreaterThanOrEqual
    from pyspark.sql.types import _parse_datatype_string

    reader = mrc_source.MrcReader(_parse_datatype_string(mrc.STACK_SCHEMA), options)
    assert not list(reader.pushFilters([GreaterThanOrEqual(("image_id",), 5)]))
    taken = []

    class Counted:
        def __init__(self, path):
            self.file = pyarrow.fs.LocalFileSystem().open_input_file(path)

        def read_at(self, n, at):
            taken.append(n)
            return self.file.read_at(n, at)

    batches = list(reader._images(Counted(str(files / "a.mrc")), "a", 0, 1 << 20))
    assert taken == [mrc.HEADER, 4 * 5 * 2, 4 * 5 * 2] and sum(b.num_rows for b in batches) == 2
    reader = mrc_source.MrcReader(_parse_datatype_string("file string, image_id long, h int"), {"path": str(files)})
    taken.clear()
    assert sum(b.num_rows for b in reader._images(Counted(str(files / "b.mrc")), "b", 0, 1 << 20)) == 40 and taken == [mrc.HEADER]


@pytest.mark.parametrize("dtype,shape", [("float32", (1, 5, 4)), ("int16", (2, 3, 3)), ("uint4", (1, 3, 5)), ("complex64", (1, 3, 4))])
def test_one_file_from_many_tasks(spark, tmp_path, dtype, shape):
    twice = 1 + dtype.startswith("complex")
    images = RNG.uniform(0, 15, size=(90, int(np.prod(shape)) * twice))
    names = ["big.mrc"] * 60 + ["sub/small.mrc"] * 30
    rows = [(n, 1000 - k, *shape, v.tolist()) for k, (n, v) in enumerate(zip(names, images, strict=True))]
    stack = spark.createDataFrame(rows, "name string, image_id long, d int, h int, w int, values array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {r["path"]: (r["images"], r["size"]) for r in mrc_source.write_mrc(stack, f"file://{tmp_path}/out", "name", dtype).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name, part in (("big.mrc", images[:60]), ("sub/small.mrc", images[60:])):
        content, want = (tmp_path / "out" / name).read_bytes(), mrc.encode(part[::-1], shape, (1.0, 1.0, 1.0), dtype)
        assert out[name] == (len(part), len(want))
        got, whole_file = (np.frombuffer(c[: mrc.HEADER], "<f4") for c in (content, want))
        assert content[mrc.HEADER :] == want[mrc.HEADER :] and np.allclose(got[[19, 20, 21, 54]], whole_file[[19, 20, 21, 54]], rtol=1e-6)
        assert content[:76] == want[:76]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["big.mrc", "sub"]


def test_odd_input(spark, tmp_path):
    none = make(spark, [np.zeros((1, 2, 2))]).withColumn("f", F.lit("x.mrc"))
    assert mrc_source.write_mrc(none.filter("image_id < 0"), f"{tmp_path}/none", "f").count() == 0
    with pytest.raises(Exception, match="no file"):
        mrc_source.write_mrc(none.withColumn("f", F.lit(None).cast("string")), f"{tmp_path}/null", "f")
    mixed = none.unionByName(make(spark, [np.zeros((1, 3, 2))]).withColumn("f", F.lit("x.mrc")))
    with pytest.raises(Exception, match="several shapes"):
        mrc_source.write_mrc(mixed, f"{tmp_path}/mixed", "f")
