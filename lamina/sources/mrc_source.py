"""MRC files as a Spark data source, read by byte ranges, and files written by many tasks each.

    register(spark)
    spark.read.format("mrc").option("first_plane", 2).option("n_planes", 3).load(folder).filter("image_id between 40 and 139")

A task reads the headers of its files and the bytes of the images and planes asked for, nothing else. Paths go through
any file system that Arrow knows; names that begin with _ or . are skipped.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.dense import arrays, pieces, shapes
from .mrc import HEADER, PIECE, STACK_SCHEMA, _values, header, pooled, read_header, stored
from .shared import written

SUFFIXES = ".mrc,.mrcs,.st,.map"
#: Bytes that a task reads at most, but for one image, where nothing is pruned; bytes that are copied at once.
SPLIT = 128 << 20
CHUNK = 8 << 20
#: Rows without values that are made at once.
ROWS = 1 << 14


def register(spark: SparkSession) -> None:
    """Make format("mrc") known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MrcSource)


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path below the folder, first byte, end) that a task reads: the images that begin in them."""

    ranges: list[tuple[str, int, int]]


def packed(files: list[tuple[str, int]], split: int) -> list[Ranges]:
    """Files (path, length) in ranges of `split` bytes, the small ones together."""
    out: list[Ranges] = []
    held: list[tuple[str, int, int]] = []
    room = split
    for path, length in sorted(files):
        if length > split:
            out += [Ranges([(path, at, min(at + split, length))]) for at in range(0, length, split)]
            continue
        if length > room and held:
            out.append(Ranges(held))
            held, room = [], split
        held.append((path, 0, length))
        room -= length
    return [*out, Ranges(held)] if held else out


class MrcSource(DataSource):
    """Columns as `mrc.read_mrc` has them. With a schema that leaves out `values`, only headers are read.

    Options: first_plane, n_planes (those planes of each image), suffixes (of names, comma-separated), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "mrc"

    def schema(self) -> str:
        return STACK_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return MrcReader(schema, dict(self.options))


class MrcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        known = [c.strip().split(" ")[0] for c in STACK_SCHEMA.split(",")]
        self.columns = schema.fieldNames()
        if not set(self.columns) <= set(known):
            raise ValueError(f"the columns are {known}")
        self.path = options["path"].rstrip("/")
        self.suffixes = tuple(options.get("suffixes", SUFFIXES).split(","))
        self.split = int(options.get("split", SPLIT))
        self.first_plane = int(options.get("first_plane", 0))
        self.n_planes = int(options["n_planes"]) if "n_planes" in options else None
        if self.split < 1 or self.first_plane < 0 or (self.n_planes or 0) < 0:
            raise ValueError("split is at least 1, first_plane and n_planes at least 0")
        #: Of the pushed filters: the least and greatest image, sets of images and of files.
        self.low, self.high = 0, None
        self.images: set[int] | None = None
        self.files: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        column = getattr(f, "attribute", None)
        if column not in (("image_id",), ("file",)):
            return False
        if isinstance(f, IsNotNull):  # both columns always have a value
            return True
        if isinstance(f, (EqualTo, In)):
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
            name = "images" if column == ("image_id",) else "files"
            before = getattr(self, name)
            setattr(self, name, asked if before is None else before & asked)
            return True
        if column == ("file",):
            return False
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            return True
        if isinstance(f, (LessThan, LessThanOrEqual)):
            last = f.value - isinstance(f, LessThan)
            self.high = last if self.high is None else min(self.high, last)
            return True
        return False

    def _named(self, below: str) -> str:
        return f"{self.path}/{below}" if below else self.path

    def partitions(self) -> list[Ranges]:
        """Names and lengths are listed; no file is opened."""
        store, root = pyarrow.fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        if info.type == pyarrow.fs.FileType.File:
            found = [("", info.size)]
        else:
            listed = store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
            found = [(i.path[len(root) :].lstrip("/"), i.size) for i in listed if i.type == pyarrow.fs.FileType.File and i.path.endswith(self.suffixes)]
            found = [(p, n) for p, n in found if not any(part.startswith(("_", ".")) for part in p.split("/"))]
        if self.files is not None:
            found = [(p, n) for p, n in found if self._named(p) in self.files]
        return packed(found, self.split)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(self.path)
        for below, begin, end in partition.ranges:
            with store.open_input_file(posixpath.join(root, below) if below else root) as file:
                yield from self._images(file, self._named(below), begin, end)

    def _images(self, file: pa.NativeFile, name: str, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        (n, d, h, w), spacing, kind, is_packed, each, start = read_header(file.read_at(HEADER, 0))
        size = each * np.dtype(kind).itemsize
        if not size:
            return
        first, last = (max(0, -((start - at) // size)) for at in (begin, end))  # the first image that begins at or after a byte
        first, last = max(first, self.low), min(n, last, n if self.high is None else self.high + 1)
        planes = min(max(0, d - self.first_plane), d if self.n_planes is None else self.n_planes)
        part, skipped = size // d * planes, size // d * self.first_plane
        wanted = range(first, last) if self.images is None else sorted(i for i in self.images if i is not None and first <= i < last)
        step = max(1, PIECE // max(1, each // d * planes)) if "values" in self.columns else ROWS
        for at in range(0, len(wanted), step):
            ids = list(wanted[at : at + step])
            yield self._batch(name, ids, (planes, h, w), spacing, self._read(file, ids, start + skipped, size, part, kind, w, is_packed) if "values" in self.columns else None)

    def _read(self, file: pa.NativeFile, ids: list[int], start: int, size: int, part: int, kind: str, width: int, is_packed: bool) -> np.ndarray:
        """The wanted part of each image, whole neighbours in one read."""
        runs = [ids] if part == size and ids[-1] - ids[0] == len(ids) - 1 else [[i] for i in ids]
        data = np.concatenate([np.frombuffer(file.read_at(part * len(run), start + run[0] * size), kind) for run in runs])
        return _values(data, len(ids), width, is_packed)

    def _batch(self, name: str, ids: list[int], shape: tuple[int, ...], spacing: list[float], values: np.ndarray | None) -> pa.RecordBatch:
        n = len(ids)
        made = {
            "file": lambda: pa.array([name] * n, pa.string()),
            "image_id": lambda: pa.array(ids, pa.int64()),
            **{c: lambda v=v: pa.array([v] * n, pa.int32()) for c, v in zip("dhw", shape, strict=True)},
            "spacing": lambda: pa.array([spacing] * n, pa.list_(pa.float64())),
            "values": lambda: pa.array(list(values), pa.list_(pa.float64())),
        }
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], self.columns)


# --- writing ---------------------------------------------------------------------------------------------------------

KNOWN = ("n", "low", "high", "mean", "m2")
PART = "path string, first long, part string, images long, d int, h int, w int, " + ", ".join(f"{k} {'long' if k == 'n' else 'double'}" for k in KNOWN)


class _Part:
    """A file's consecutive images from one task, without a header."""

    def __init__(self, store: pyarrow.fs.FileSystem, root: str, path: str, first: int, shape: tuple[int, ...], dtype: str):
        self.path, self.first, self.shape, self.dtype = path, first, shape, dtype
        self.name, self.images, self.known = uuid.uuid4().hex, 0, []
        self.out = store.open_output_stream(posixpath.join(root, self.name))

    def add(self, images: list[np.ndarray]) -> None:
        data, known = stored(np.stack(images), self.shape, self.dtype)
        self.out.write(data.tobytes())
        self.images += len(images)
        self.known = [pooled([*self.known, known])]

    def row(self) -> pa.RecordBatch:
        self.out.close()
        known = dict(zip(KNOWN, (self.known[0] or [None] * len(KNOWN)), strict=True))
        row = {"path": self.path, "first": self.first, "part": self.name, "images": self.images, **dict(zip("dhw", self.shape, strict=True)), **known}
        types = {"path": pa.string(), "first": pa.int64(), "part": pa.string(), "images": pa.int64(), **{c: pa.int32() for c in "dhw"}, **{k: pa.int64() if k == "n" else pa.float64() for k in KNOWN}}
        return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in types.items()], list(types))


def write_mrc(stack: DataFrame, folder: str, file: str, dtype: str = "float32", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Each value of the column `file` as one file folder/<value>, its images in order of image_id (one shape a file), however
    long: path, images and size of each.

    The stack is sorted over all tasks by file and image. A task stores its runs of images as parts, a piece in memory
    at a time; then one task a file writes the header, whose statistics are pooled from the parts, and
    copies the parts after it, and the whole file takes its name at once. A repeated task makes parts of new names, so
    none is counted twice. Images of equal ids stay in any order. A file without a name is an error.
    """
    parts = f"{folder.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    keyed = stack.select(F.col(file).cast("string").alias("path"), "image_id", "d", "h", "w", "values")
    placed = keyed.repartitionByRange("path", "image_id").sortWithinPartitions("path", "image_id")

    def store_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(parts)
        store.create_dir(root, recursive=True)
        part = None
        for batch in pieces(batches):
            paths, firsts = batch.column("path").to_pylist(), batch.column("image_id").to_pylist()
            if None in paths:
                raise ValueError("an image has no file")
            each, values = shapes(batch), arrays(batch)
            at = 0
            while at < len(paths):
                end = at
                while end < len(paths) and paths[end] == paths[at] and each[end] == each[at]:
                    end += 1
                if part is None or part.path != paths[at] or part.shape != each[at]:
                    if part is not None:
                        yield part.row()
                    part = _Part(store, root, paths[at], firsts[at], each[at], dtype)
                part.add(values[at:end])
                at = end
        if part is not None:
            yield part.row()

    def join_parts(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["first"] is not None, r["first"] or 0))
        path, shape = rows[0]["path"], tuple(rows[0][c] for c in "dhw")
        if any(tuple(r[c] for c in "dhw") != shape for r in rows):
            raise ValueError(f"the images of {path} have several shapes")
        n = sum(r["images"] for r in rows)
        known = pooled([tuple(r[k] for k in KNOWN) if r["n"] is not None else None for r in rows])
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        final = posixpath.join(root, path)
        store.create_dir(posixpath.dirname(final), recursive=True)
        made = posixpath.join(posixpath.dirname(final), f"_{uuid.uuid4().hex}")
        size = HEADER
        with store.open_output_stream(made) as out:
            out.write(header(n, shape, spacing, dtype, known))
            for r in rows:
                with store.open_input_stream(posixpath.join(root, posixpath.basename(parts), r["part"])) as held:
                    while data := held.read(CHUNK):
                        out.write(data)
                        size += len(data)
        store.move(made, final)
        return pa.table({"path": [path], "images": pa.array([n], pa.int64()), "size": pa.array([size], pa.int64())})

    stored_parts = written(placed.mapInArrow(store_parts, PART))
    files = written(stored_parts.groupBy("path").applyInArrow(join_parts, "path string, images long, size long"))
    store, root = pyarrow.fs.FileSystem.from_uri(parts)
    if store.get_file_info(root).type == pyarrow.fs.FileType.Directory:  # none were made of an empty stack
        store.delete_dir(root)
    return files
