"""MRC files: a header of 1024 bytes, then the images one after another.

Reading takes Spark's binaryFile rows; writing makes one row (file, content) per file, which `save` stores
through any file system that Arrow knows. For files that fit no task: `mrc_source`.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = 1024
#: Values that are decoded at once, one image at least; bytes of a file that Spark reads in one piece.
PIECE = 1 << 20
WHOLE = 256 << 20
#: Fixed values of the format: data mode -> numpy type (complex modes are pairs).
MODES = {0: "i1", 1: "i2", 2: "f4", 3: "i2", 4: "f4", 6: "u2", 12: "f2"}
COMPLEX = (3, 4)
#: Two values a byte, the first in the low bits; a row of odd width ends in half a byte.
PACKED = 101
MODE_OF = {"int8": 0, "uint8": 0, "int16": 1, "float32": 2, "uint16": 6, "float16": 12, "uint4": PACKED, "complex_int16": 3, "complex64": 4}
RANGE = {"uint4": (0, 15), "int8": (-128, 127), "uint8": (0, 255), "int16": (-32768, 32767), "uint16": (0, 65535)}
IMOD_STAMP = 1146047817
STACK_SCHEMA = "file string, image_id long, d int, h int, w int, spacing array<double>, values array<double>"


def read_header(content: bytes) -> tuple[tuple[int, int, int, int], list[float], str, bool, int, int]:
    """Of a file's first 1024 bytes: shape (images, depth, height, width), spacing (z, y, x), numpy type of the stored
    numbers, whether two values share a byte, stored numbers of one image, and where they begin."""
    order = ">" if content[212:214] == b"\x11\x11" else "<"
    ints = np.frombuffer(content, order + "i4", 56)
    floats = np.frombuffer(content, order + "f4", 56)
    nx, ny, nz, mode = (int(v) for v in ints[:4])
    grid, cell = ints[7:10].astype(float), floats[10:13].astype(float)
    group, extra = int(ints[22]), int(ints[23])
    if mode not in MODES and mode != PACKED:
        raise ValueError(f"MRC mode {mode} is not supported")
    kind = MODES.get(mode, "u1")
    if mode == 0 and ints[38] == IMOD_STAMP and not ints[39] & 1:
        kind = "u1"
    row = (nx + 1) // 2 if mode == PACKED else nx * (1 + (mode in COMPLEX))
    if group == 0:
        shape = (nz, 1, ny, nx)
    elif group == 1:
        shape = (1, nz, ny, nx)
    else:
        mz = int(ints[9])
        shape = (nz // mz, mz, ny, nx)
    spacing = [float(c / g) if g else 0.0 for c, g in zip(cell, grid, strict=True)][::-1]
    return shape, spacing, order + kind, mode == PACKED, row * ny * shape[1], HEADER + extra


def _values(data: np.ndarray, n: int, width: int, packed: bool) -> np.ndarray:
    """Stored numbers as double, one image a row."""
    if packed:
        row = (width + 1) // 2
        data = np.stack([data & 15, data >> 4], axis=-1).reshape(-1, 2 * row)[:, :width]
    return data.astype(np.float64).reshape(n, data.size // max(1, n))


def decode(content: bytes) -> tuple[tuple[int, int, int, int], list[float], np.ndarray]:
    """Shape (images, depth, height, width), spacing (z, y, x) and the values as double, one image a row."""
    shape, spacing, kind, packed, each, start = read_header(content[:HEADER])
    data = np.frombuffer(content, kind, each * shape[0], start)
    return shape, spacing, _values(data, shape[0], shape[3], packed)


def stored(images: np.ndarray, shape: tuple[int, int, int], dtype: str) -> tuple[np.ndarray, tuple[float, ...] | None]:
    """images (n, d * h * w, twice as many for complex types: real and imaginary parts in turn) as the numbers that a file
    holds, and their count, least, greatest, mean and sum of squared differences from it (None for complex types and
    no numbers). Values are clamped to the type's range and truncated; NaN becomes 0."""
    part = {"complex_int16": "int16", "complex64": "float32"}.get(dtype, dtype)
    if images.shape[1] != shape[0] * shape[1] * shape[2] * (1 + (part != dtype)):
        raise ValueError(f"an image of {images.shape[1]} values does not fit {shape} of {dtype}")
    if part in RANGE:
        lo, hi = RANGE[part]
        data = np.trunc(np.clip(np.nan_to_num(images, nan=0.0), lo, hi)).astype("uint8" if part == "uint4" else part)
    else:
        data = images.astype(part)
    known = None
    if data.size and part == dtype:
        wide = data.astype(np.float64)
        known = (data.size, float(data.min()), float(data.max()), float(wide.mean()), float(wide.var() * data.size))
    if dtype == "uint4":
        w = shape[2]
        pairs = np.pad(data.reshape(-1, w), ((0, 0), (0, w % 2))).reshape(-1, 2)
        data = pairs[:, 0] | pairs[:, 1] << 4
    return np.ascontiguousarray(data), known


def pooled(known: list[tuple[float, ...] | None]) -> tuple[float, ...] | None:
    """The statistics of several pieces as those of all; None if a piece has none."""
    if not known or None in known:
        return None
    n, mean, m2 = 0, 0.0, 0.0
    for count, _, _, own, squares in known:
        step = own - mean
        n += count
        mean += step * count / n
        m2 += squares + step * step * count * (n - count) / n
    return n, min(k[1] for k in known), max(k[2] for k in known), mean, m2


def header(n: int, shape: tuple[int, int, int], spacing: tuple[float, float, float], dtype: str, known: tuple[float, ...] | None) -> bytes:
    """The first 1024 bytes of a file of n images."""
    d, h, w = shape
    ints = np.zeros(HEADER // 4, "<i4")
    floats = ints.view("<f4")
    ints[0:4] = w, h, n * d, MODE_OF[dtype]
    ints[7:10] = w, h, d if d > 1 else n
    floats[10:13] = [spacing[2] * w, spacing[1] * h, spacing[0] * (d if d > 1 else n)]
    floats[13:16] = 90
    ints[16:19] = 1, 2, 3
    floats[19:22] = [known[1], known[2], known[3]] if known else [0, -1, -2]
    ints[22] = 0 if d == 1 else (1 if n == 1 else 401)
    if dtype in ("int8", "uint8"):
        ints[38], ints[39] = IMOD_STAMP, int(dtype == "int8")
    ints[52] = int.from_bytes(b"MAP ", "little")
    ints[53] = int.from_bytes(b"\x44\x44\x00\x00", "little")
    floats[54] = (known[4] / known[0]) ** 0.5 if known else -1
    return ints.tobytes()


def encode(images: np.ndarray, shape: tuple[int, int, int], spacing: tuple[float, float, float], dtype: str) -> bytes:
    """images as `stored` takes them as one file. Complex files store no statistics."""
    data, known = stored(images, shape, dtype)
    return header(len(images), shape, spacing, dtype, known) + data.tobytes()


def _stack_rows(path: str, first: int, shape: tuple[int, int, int, int], spacing: list[float], data: np.ndarray) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([path] * n, pa.string()),
            pa.array(range(first, first + n), pa.int64()),
            *(pa.array([v] * n, pa.int32()) for v in shape[1:]),
            pa.array([spacing] * n, pa.list_(pa.float64())),
            pa.array(list(data), pa.list_(pa.float64())),
        ],
        ["file", "image_id", "d", "h", "w", "spacing", "values"],
    )


def from_files(files: DataFrame) -> DataFrame:
    """Rows of files (path, content) as a stack; image_id numbers the images of each file from 0. A piece of a file's
    images is decoded at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = content.as_buffer()
                shape, spacing, kind, packed, each, start = read_header(held[:HEADER].to_pybytes())
                step = max(1, PIECE // max(1, each))
                for first in range(0, shape[0], step):
                    n = min(step, shape[0] - first)
                    data = np.frombuffer(held, kind, each * n, start + first * each * np.dtype(kind).itemsize)
                    yield _stack_rows(path, first, shape, spacing, _values(data, n, shape[3], packed))

    return files.select("path", "content").mapInArrow(run, STACK_SCHEMA)


def from_ranges(files: DataFrame) -> DataFrame:
    """Files (path) of any length as a stack: a task reads a file's header and lists pieces of its images, which are dealt
    out and read by their byte ranges, through any file system that Arrow knows."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    shape, _, _, _, each, _ = read_header(file.read(HEADER))
                step = max(1, PIECE // max(1, each))
                firsts = list(range(0, shape[0], step))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(firsts)), pa.array(firsts, pa.int64()), pa.array([min(step, shape[0] - f) for f in firsts], pa.int64())], ["path", "first", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, n in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n")), strict=True):
                store, place = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    shape, spacing, kind, packed, each, start = read_header(file.read(HEADER))
                    size = each * np.dtype(kind).itemsize
                    data = np.frombuffer(file.read_at(n * size, start + first * size), kind)
                yield _stack_rows(path, first, shape, spacing, _values(data, n, shape[3], packed))

    ranges = files.select("path").mapInArrow(listed, "path string, first long, n long")
    return ranges.repartition("path", "first").mapInArrow(read, STACK_SCHEMA)


def read_mrc(spark: SparkSession, path: str, pattern: str = "*.{mrc,mrcs,st,map}", whole: int = WHOLE) -> DataFrame:
    """All MRC files of a folder as one stack. Files of at most `whole` bytes come through Spark in one piece, longer
    ones by their ranges."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    small = from_files(files.filter(F.col("length") <= whole))
    if files.filter(F.col("length") > whole).select("path").isEmpty():  # reads names and lengths alone
        return small
    return small.unionByName(from_ranges(files.filter(F.col("length") > whole)))


def to_files(stack: DataFrame, file: str, dtype: str = "float32", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """path, content: one MRC file for each value of the column `file`, its images in order of image_id. A
    file is made by one task, so choose keys that bound its size."""
    keyed = stack.select(F.col(file).cast("string").alias("path"), "image_id", "d", "h", "w", "values")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("image_id")
        shape = tuple(table.column(c)[0].as_py() for c in "dhw")
        images = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        return pa.table([table.column("path").slice(0, 1), pa.array([encode(images, shape, spacing, dtype)], pa.binary())], ["path", "content"])

    return keyed.groupBy("path").applyInArrow(run, "path string, content binary")


def save(files: DataFrame, folder: str) -> DataFrame:
    """Store each row's content under folder/path (overwriting, so a repeated task does no harm); path and size of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(posixpath.join(root, path)) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "size"])

    return files.select("path", "content").mapInArrow(run, "path string, size long")
