"""Data sources for binary files of points, labels and weighted points (little-endian), read by ranges of rows and written by task.

    points_bin    u32 number of dimensions, u32 each, then f32 values row by row; trailing dimensions are one feature axis
    labels_bin    u64 count (not relied on: files are read to their end), then u64 labels
    coreset_bin   u32 rows, u32 features, then f32 rows of the weight and the features

A path is a file, or a folder whose files are read in order of name; ids go on from file to file. A writer makes a whole file for each
`CHUNK_ROWS` rows of a task, so that a task holds no more than that; coalesce(1) and fewer rows give one file. Rows are in order of id within
a file. Names appear when a job is complete: a job's number, the task and the chunk, and an id of the job, so that no job writes over
another's files. The driver gives names one by one: a crash meanwhile leaves a part of the job under its names, and the rest as `.part`
files, which are never read. Overwriting deletes the old files after the new ones are there: a crash between leaves both, never neither.

Streams are written too. A micro-batch is committed once: a manifest under _batches names its files before they get their names, so a batch
that is tried again finds the manifest, completes what it says and drops its own files.

Conditions on id (ranges, equality, lists) are pushed to the reader where `register()` has switched that on: it opens no more than the rows
from the least to the largest id, and Spark checks the rest. All columns of a row are read, as rows are what files hold.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FILE_TYPES = {"points_bin": "id long, features array<float>", "labels_bin": "id long, label long", "coreset_bin": "weight float, features array<float>"}
BATCH_ROWS = 65_536


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.FileSystem.from_uri(uri)) if "://" in uri else (pafs.LocalFileSystem(), uri)


def files_of(uri: str) -> list[str]:
    fs, path = store(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.is_file:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(path))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")) and not f.base_name.endswith(".part"))


@dataclass
class Layout:
    """Where a file's rows begin, how many there are, and how many values of what type each has."""

    head: int
    rows: int
    width: int
    dtype: str

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.dtype).itemsize


def layout_of(kind: str, fs: pafs.FileSystem, path: str) -> Layout:
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        if kind == "labels_bin":
            made = Layout(8, max(0, size - 8) // 8, 1, "<u8")
        elif kind == "coreset_bin":
            rows, dims = np.frombuffer(f.read(8), "<u4").tolist()
            made = Layout(8, rows, dims + 1, "<f4")
        else:
            n = int(np.frombuffer(f.read(4), "<u4")[0])
            shape = np.frombuffer(f.read(4 * n), "<u4").tolist()
            made = Layout(4 + 4 * n, shape[0] if shape else 0, int(np.prod(shape[1:], dtype=np.int64)), "<f4")
    if made.head + made.rows * made.row_bytes > size or kind == "labels_bin" and (size < 8 or size % 8):
        raise ValueError(f"{path} is shorter than its header says")
    return made


@dataclass
class Rows(InputPartition):
    path: str
    layout: Layout
    first: int
    count: int
    first_id: int


class BinaryReader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.uri = kind, options["path"]
        self.each = int(options.get("rowsPerPartition", 1_000_000))
        self.low, self.high = 0, 1 << 63  # ids from low to before high

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if self.kind != "coreset_bin" and getattr(f, "attribute", None) == ("id",):
                if isinstance(f, EqualTo) and f.value is not None:
                    self._within(f.value, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self._within(f.value, self.high)
                elif isinstance(f, GreaterThan):
                    self._within(f.value + 1, self.high)
                elif isinstance(f, LessThan):
                    self._within(self.low, f.value)
                elif isinstance(f, LessThanOrEqual):
                    self._within(self.low, f.value + 1)
                elif isinstance(f, In) and f.value:
                    self._within(min(f.value), max(f.value) + 1)
            yield f  # Spark applies all of them to what is read

    def _within(self, low: int, high: int) -> None:
        self.low, self.high = max(self.low, low), min(self.high, high)

    def partitions(self) -> list[Rows]:
        fs, _ = store(self.uri)
        out, ids = [], 0
        for path in files_of(self.uri):
            lay = layout_of(self.kind, fs, path)
            first, end = max(0, self.low - ids), min(lay.rows, self.high - ids)
            out += [Rows(path, lay, at, min(self.each, end - at), ids + at) for at in range(first, end, self.each)]
            ids += lay.rows
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, lay = store(self.uri)[0], partition.layout
        with fs.open_input_file(partition.path) as f:
            f.seek(lay.head + partition.first * lay.row_bytes)
            for at in range(0, partition.count, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.count - at)
                values = np.frombuffer(f.read(n * lay.row_bytes), lay.dtype).reshape(n, lay.width)
                ids = pa.array(partition.first_id + at + np.arange(n))
                if self.kind == "labels_bin":
                    yield pa.record_batch([ids, pa.array(values[:, 0].astype(np.int64))], ["id", "label"])
                    continue
                body = values[:, 1:] if self.kind == "coreset_bin" else values
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * body.shape[1]), pa.array(np.ascontiguousarray(body).reshape(-1)))
                yield pa.record_batch([pa.array(values[:, 0].copy()), lists] if self.kind == "coreset_bin" else [ids, lists], ["weight", "features"] if self.kind == "coreset_bin" else ["id", "features"])


CHUNK_ROWS = 1_000_000


@dataclass
class Written(WriterCommitMessage):
    parts: list[str]
    task: int


class _Parts:
    """Rows of a task: id and features, id and label, or weight and features, in files that nothing reads yet."""

    def __init__(self, kind: str, options: dict):
        self.kind, self.uri = kind, options["path"]
        self.job, self.chunk = uuid.uuid4().hex, int(options.get("rowsPerFile", CHUNK_ROWS))

    def _raw(self, rows: pa.Table) -> bytes:
        if self.kind != "coreset_bin":
            rows = rows.sort_by("id")
        if self.kind == "labels_bin":
            return np.array([rows.num_rows], "<u8").tobytes() + rows.column("label").to_numpy().astype("<u8").tobytes()
        lists = rows.column("features").combine_chunks()
        body = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(rows.num_rows, -1)
        if self.kind == "coreset_bin":
            body = np.column_stack([rows.column("weight").to_numpy().astype("<f4"), body])
            return np.array([rows.num_rows, body.shape[1] - 1], "<u4").tobytes() + body.tobytes()
        return np.array([2, *body.shape], "<u4").tobytes() + body.tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, path = store(self.uri)
        held, rows, parts = [], 0, []

        def flush() -> None:
            fs.create_dir(path, recursive=True)
            part = f"{path}/{self.job}-{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part, compression=None) as f:
                f.write(self._raw(pa.Table.from_batches(held)))
            parts.append(part)

        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                own = batch.slice(at, min(self.chunk - rows, batch.num_rows - at))
                held.append(own)
                at, rows = at + own.num_rows, rows + own.num_rows
                if rows == self.chunk:
                    flush()
                    held, rows = [], 0
        if rows:
            flush()
        return Written(parts, TaskContext.get().partitionId())

    def drop(self, messages: list) -> None:
        fs, _ = store(self.uri)
        for m in messages:
            for part in m.parts if m is not None else []:
                if fs.get_file_info(part).is_file:
                    fs.delete_file(part)


class BinaryWriter(_Parts, DataSourceArrowWriter):
    def __init__(self, kind: str, options: dict, overwrite: bool):
        super().__init__(kind, options)
        self.overwrite = overwrite

    def commit(self, messages: list) -> None:
        fs, path = store(self.uri)
        fs.create_dir(path, recursive=True)
        old = files_of(self.uri)
        numbers = [int(m[1]) for f in old if (m := re.search(r"/part-(\d+)-[^/]*$", f))]
        first = 1 + max([*numbers, 0] if old else [-1])
        for m in messages:
            for k, part in enumerate(m.parts if m is not None else []):
                fs.move(part, f"{path}/part-{first:06d}-{m.task:06d}-{k:04d}-{self.job[:8]}.bin")
        for gone in old if self.overwrite else []:
            fs.delete_file(gone)

    def abort(self, messages: list) -> None:
        self.drop(messages)


class BinaryStreamWriter(_Parts, DataSourceStreamArrowWriter):
    """Micro-batches, each committed once, however often it is tried."""

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        fs, path = store(self.uri)
        manifest = f"{path}/_batches/{batchId:012d}"
        fs.create_dir(f"{path}/_batches", recursive=True)
        if fs.get_file_info(manifest).is_file:
            self.drop(messages)
        else:
            names = [(part, f"{path}/part-{batchId:012d}-{m.task:06d}-{k:04d}.bin") for m in messages if m is not None for k, part in enumerate(m.parts)]
            with fs.open_output_stream(f"{manifest}.part", compression=None) as f:
                f.write(json.dumps(names).encode())
            fs.move(f"{manifest}.part", manifest)
        with fs.open_input_file(manifest) as f:
            for part, name in json.loads(f.read()):
                if fs.get_file_info(part).is_file:
                    fs.move(part, name)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.drop(messages)


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return FILE_TYPES[self.kind]

    def reader(self, schema) -> BinaryReader:  # noqa: ANN001
        return BinaryReader(self.kind, self.options)

    def writer(self, schema, overwrite: bool) -> BinaryWriter:  # noqa: ANN001
        return BinaryWriter(self.kind, self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> BinaryStreamWriter:  # noqa: ANN001, N802
        return BinaryStreamWriter(self.kind, self.options)


class PointsBin(_Source):
    kind = "points_bin"


class LabelsBin(_Source):
    kind = "labels_bin"


class CoresetBin(_Source):
    kind = "coreset_bin"


def register(spark: SparkSession) -> None:
    """Formats points_bin, labels_bin and coreset_bin for spark.read, df.write and writeStream, with conditions pushed to readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PointsBin, LabelsBin, CoresetBin):
        spark.dataSource.register(source)
