"""`.npy` and `.npz` arrays as Spark tables: frames, the catalogue of fields, and a writer.

Files are opened through the file systems of Arrow, by path or URI, so they need not be local. A reader task
gets slices of leading indices and seeks to them; arrays that are compressed or in Fortran order are read up to
them or whole. Beyond a few dozen slices neighbours share a task, and beyond as many files tasks are made of the listed sizes
and no header is read before the tasks run.
"""

from __future__ import annotations

import fnmatch
import io
import math
import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import chain, groupby
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldgauge.operators import ranks as R
from fieldgauge.sources.files import written


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


#: So many units are a task each; of more, neighbours share a task up to so many bytes, or files of a catalogue.
FEW, TASK_BYTES, TASK_FILES = 64, 8 << 20, 64
BATCH_VALUES = 1 << 22  # numbers that are handed on at once, a frame at least


def _listed(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of `array_files`."""
    fixed = path[: min([path.find(c) for c in "*?[" if c in path] or [len(path)])]
    system, base = _system(fixed if fixed == path else fixed.rsplit("/", 1)[0])
    info = system.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    pattern = None if fixed == path else base.rstrip("/") + path[len(fixed.rsplit("/", 1)[0]) :]
    return sorted((f.path, f.size or 0) for f in found if f.path.endswith((".npy", ".npz")) and (pattern is None or fnmatch.fnmatch(f.path, pattern)))


def array_files(path: str) -> list[str]:
    """The `.npy` and `.npz` files at a path: a file, a folder with all below it, or a pattern with * or ?."""
    return [p for p, _ in _listed(path)]


def _tasks(units: list[tuple[tuple, int]], most: int) -> list[InputPartition]:
    """Tasks of neighbouring units (unit, size): one each of a few, else of up to ``most``, yet about `FEW` at least."""
    limit = 0 if len(units) <= FEW else min(most, sum(size for _, size in units) // FEW)
    out, held = [], 0
    for unit, size in units:
        if not out or not limit or held + size > limit:
            out.append([])
            held = 0
        out[-1].append(unit)
        held += size
    return [InputPartition(units) for units in out or [[]]]


class _Array:
    """Header and place of one array within an open file."""

    def __init__(self, file):
        self.file = file
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, self.fortran, self.dtype = read(file)
        self.start = file.tell()

    def rows(self, a: int, b: int) -> np.ndarray:
        """Entries a to b of the leading index, as floats."""
        if self.dtype.kind not in "biuf":
            raise ValueError(f"an array of {self.dtype} has no numbers to screen")
        each, whole = reduce(mul, self.shape[1:], 1), reduce(mul, self.shape, 1)
        if self.fortran or not self.shape:
            self.file.seek(self.start)
            flat = np.frombuffer(self.file.read(whole * self.dtype.itemsize), self.dtype)
            return flat.reshape(self.shape or (1,), order="F" if self.fortran else "C")[a:b].astype(float)
        self.file.seek(self.start + a * each * self.dtype.itemsize)
        return np.frombuffer(self.file.read((b - a) * each * self.dtype.itemsize), self.dtype).reshape((b - a, *self.shape[1:])).astype(float)

    def slices(self, step: int) -> list[tuple[int, int]]:
        n = self.shape[0] if self.shape else 1
        return [(a, min(a + step, n)) for a in range(0, n, step)]


@contextmanager
def _members(system: fs.FileSystem, path: str):
    """name -> a function that opens the array; a `.npy` file has one, named as the file."""
    with system.open_input_file(path) as file:
        if path.endswith(".npz"):
            with zipfile.ZipFile(file) as z:
                yield {n[:-4]: (lambda n=n: _Array(z.open(n))) for n in z.namelist() if n.endswith(".npy")}
        else:
            yield {os.path.basename(path)[:-4]: lambda: _Array(file)}


class _Source(DataSource):
    def reader(self, schema):
        return self.READER(self.options)


class _CatalogueReader(DataSourceReader):
    def __init__(self, options):
        self.system, _ = _system(options["path"].split("*")[0].split("?")[0])
        self.files = _listed(options["path"])

    def __getstate__(self):
        return {**self.__dict__, "files": []}  # tasks have their own files and need not be sent all

    def partitions(self):
        return _tasks([(path, 1) for path, _ in self.files], TASK_FILES)

    def read(self, partition) -> Iterator[tuple]:
        for path in partition.value:
            with _members(self.system, path) as members:
                for name, opened in members.items():
                    a = opened()
                    yield path, name, str(a.dtype), list(a.shape), math.prod(a.shape) * a.dtype.itemsize


class ArrayCatalogue(_Source):
    """Format ``array_catalogue``: one row for each array, from its header. Option ``path``: see `array_files`."""

    READER = _CatalogueReader

    @classmethod
    def name(cls) -> str:
        return "array_catalogue"

    def schema(self) -> str:
        return "file string, name string, dtype string, shape array<int>, bytes bigint"


class _FrameReader(_CatalogueReader):
    def __init__(self, options):
        super().__init__(options)
        self.step = int(options.get("frames", "64"))
        self.wanted = set(filter(None, options.get("fields", "").split(",")))

    def fits(self, name: str) -> bool:
        return not self.wanted or name in self.wanted or name.split("/")[-1] in self.wanted

    def partitions(self):
        """Units are (path, name, slices), or of many files (path, None, (i, k)): each k-th slice of its arrays from i on."""
        units = []
        for path, size in self.files:
            if len(self.files) > FEW:
                k = size // TASK_BYTES + 1
                units += [((path, None, (i, k)), size // k) for i in range(k)]
                continue
            with _members(self.system, path) as members:
                for name, opened in members.items():
                    if self.fits(name):
                        a = opened()
                        each = math.prod(a.shape[1:]) * a.dtype.itemsize
                        units += [((path, name, [(first, last)]), (last - first) * each) for first, last in a.slices(self.step)]
        return _tasks(units, TASK_BYTES)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for path, units in groupby(partition.value, lambda u: u[0]):
            with _members(self.system, path) as members:
                for (_, name), same in groupby(units, lambda u: u[:2]):
                    spans = [u[2] for u in same]
                    if name is not None:
                        a = members[name]()
                        for first, last in chain(*spans):
                            yield from _batches(path, name, first, a.rows(first, last))
                        continue
                    for other in filter(self.fits, members):
                        a = members[other]()
                        for first, last in (x for i, k in spans for x in a.slices(self.step)[i::k]):
                            yield from _batches(path, other, first, a.rows(first, last))


def _batches(path: str, name: str, first: int, frames: np.ndarray) -> Iterator[pa.RecordBatch]:
    shape = frames.shape[1:]
    step = max(1, BATCH_VALUES // max(1, math.prod(shape)))
    for at in range(0, len(frames), step):
        part = frames[at : at + step]
        n, ends = len(part), np.arange(len(part) + 1, dtype=np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends * math.prod(shape), pa.int32()), pa.array(part.ravel(), pa.float64()))
        shapes = pa.array([list(shape)] * n, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([name] * n), pa.array(np.arange(first + at, first + at + n), pa.int64()), shapes, values], names=["file", "name", "t", "shape", "values"])


class ArrayFrames(_Source):
    """Format ``array_frames``: one row for each leading index of each array, its values flat in C order.

    Options: ``path`` (see `array_files`), ``frames`` of a slice, which is read at once (64), ``fields`` (full or leaf names
    separated by commas; all without it). An array without axes is one frame; one with a single axis has a number a frame;
    arrays of other things than numbers are an error that says so. Up to 64 slices (file, array, slice) are a task each;
    of more, neighbours share a task of up to 8 MB, and of more than 64 files tasks are made by their sizes alone.
    """

    READER = _FrameReader

    @classmethod
    def name(cls) -> str:
        return "array_frames"

    def schema(self) -> str:
        return "file string, name string, t bigint, shape array<int>, values array<double>"


def frames(spark: SparkSession, path: str, frames: int = 64, fields: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(ArrayFrames)
    return spark.read.format("array_frames").option("path", path).option("frames", str(frames)).option("fields", ",".join(fields or [])).load()


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrayCatalogue)
    return spark.read.format("array_catalogue").option("path", path).load()


def write_arrays(df: DataFrame, path: str, file: str, order: str, members: dict[str, tuple[int, ...]], per_file: int = 256) -> DataFrame:
    """Array columns as `.npz` files below ``path``: one for each value of ``file`` and ``per_file`` rows in ``order``.

    ``members`` maps each array column to the shape of its entries; rows are stacked along a leading axis. A file is
    written by one task under another name and moved, so a task that runs again leaves the same file. Returns
    (file, rows) of what was written. Null arrays are undefined numbers.
    """
    placed = R.numbered(df.select(F.col(file).cast("string").alias("file"), F.col(order).alias("order"), *members), ["file"], ["order"], "at")
    schema, folder = "file string, rows bigint", path.rstrip("/")

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        system, base = _system(folder)
        system.create_dir(base, recursive=True)
        rows, name = rows.sort_values("at"), f"{key[0]}-{key[1]}.npz"
        stacked = {c: np.stack([np.full(shape, np.nan) if v is None else np.asarray(v, float).reshape(shape) for v in rows[c]]) for c, shape in members.items()}
        held = io.BytesIO()  # a file has per_file rows, so this is bounded
        np.savez(held, **stacked)
        draft = f"{base}/{uuid.uuid4().hex}.part"
        with system.open_output_stream(draft) as out:
            out.write(held.getbuffer())
        system.move(draft, f"{base}/{name}")
        return pd.DataFrame({"file": [name], "rows": [len(rows)]})

    return written(placed.groupBy("file", F.floor(F.col("at") / per_file).alias("chunk")).applyInPandas(write, schema))
