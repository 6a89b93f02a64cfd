"""Two file formats as Spark data sources, to read and to write: flat half-precision vectors, and FASTA in Zstandard frames.

``register_formats(spark)`` makes them known as ``half_vectors`` and ``zstd_fasta``. Both
read in planned partitions (byte ranges, or groups of frames) and write one file a task:
under a name of its attempt first, which the commit gives its final name, so a task that is
repeated after a lost executor leaves nothing behind.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from kinspark.sources.files import file_system

RANGE_BYTES = 16 * 1024 * 1024
FRAME_BYTES = 1024 * 1024
BATCH_ROWS = 8192
# Fixed values of the published seekable Zstandard layout: a skippable frame with the sizes of all frames ends the file.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_WAITING = "_waiting-"


def register_formats(spark: SparkSession) -> None:
    """Make the formats known to a session, and let Spark push conditions into its Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HalfVectors)
    spark.dataSource.register(ZstdFasta)


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    """Files with the suffix and their sizes, in order of their paths: the path itself, or what its folder has."""
    store, name = file_system(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(name))
    own = [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.is_file and f.base_name.endswith(suffix) and not f.base_name.startswith("_")]
    return sorted(own)


def _bytes(path: str, start: int, size: int) -> bytes:
    store, name = file_system(path)
    with store.open_input_file(name) as source:
        source.seek(start)
        return source.read(size)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    size: int
    first: int = 0

    def __post_init__(self):
        self.value = self.path


@dataclass
class _Written(WriterCommitMessage):
    waiting: str
    final: str


class _FileWriter(DataSourceArrowWriter):
    """One file a task; empty partitions write none."""

    suffix = ""

    def __init__(self, path: str, overwrite: bool):
        self.path = path.rstrip("/")
        if overwrite:
            for old, _ in _files(self.path, self.suffix) if self._exists() else []:
                store, name = file_system(old)
                store.delete_file(name)
        store, name = file_system(self.path)
        store.create_dir(name, recursive=True)

    def _exists(self) -> bool:
        store, name = file_system(self.path)
        return store.get_file_info(name).type == fs.FileType.Directory

    def encode(self, batches: Iterator[pa.RecordBatch], sink) -> int:
        """Writes the rows and returns their number."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        final = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}{self.suffix}"
        waiting = f"{_WAITING}{final}"
        store, name = file_system(f"{self.path}/{waiting}")
        with store.open_output_stream(name, compression=None) as sink:
            n = self.encode(iterator, sink)
        if not n:
            store.delete_file(name)
        return _Written(waiting if n else "", final)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.waiting:
                store, name = file_system(f"{self.path}/{m.waiting}")
                store.move(name, file_system(f"{self.path}/{m.final}")[1])

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.waiting:
                store, name = file_system(f"{self.path}/{m.waiting}")
                store.delete_file(name)


# --- half-precision vectors -----------------------------------------------------------------------


class HalfVectors(DataSource):
    """``centroid_idx`` (the row's number over all files, by path) and ``embedding`` of flat little-endian float16 files.

    Option ``dim``: the vectors' length. Conditions on ``centroid_idx`` choose byte ranges before
    anything is read. A file that does not hold whole rows is refused. Rows are written in the
    order they come in, without their key: sort them by it first.
    """

    @classmethod
    def name(cls) -> str:
        return "half_vectors"

    def schema(self) -> str:
        return "centroid_idx long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _HalfReader(self.options["path"], int(self.options.get("dim", 512)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _HalfWriter(self.options["path"], int(self.options.get("dim", 512)), overwrite)


class _HalfReader(DataSourceReader):
    def __init__(self, path: str, dim: int):
        self.path, self.dim = path, dim
        self.least, self.most = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("centroid_idx",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.most = min(self.most, f.value - isinstance(f, LessThan))
            # Ranges hold other rows too, so every condition is also applied by Spark.
            yield f

    def partitions(self) -> list[InputPartition]:
        width, base, found = 2 * self.dim, 0, []
        step = max(1, RANGE_BYTES // width)
        for path, size in _files(self.path, ".f16"):
            if size % width:
                raise ValueError(f"not a whole number of {width}-byte rows: {path} ({size} bytes)")
            for first in range(0, size // width, step):
                n = min(step, size // width - first)
                if base + first <= self.most and base + first + n > self.least:
                    found.append(_Range(path, first * width, n * width, base + first))
            base += size // width
        return found

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        # Spark asks once where there is nothing to read.
        if partition is None:
            return
        width = 2 * self.dim
        for at in range(0, partition.size, BATCH_ROWS * width):
            data = _bytes(partition.path, partition.start + at, min(BATCH_ROWS * width, partition.size - at))
            flat = np.frombuffer(data, "<f2").astype(np.float32)
            keys = np.arange(len(data) // width) + partition.first + at // width
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, self.dim, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(keys), vectors], ["centroid_idx", "embedding"])


class _HalfWriter(_FileWriter):
    suffix = ".f16"

    def __init__(self, path: str, dim: int, overwrite: bool):
        self.dim = dim
        super().__init__(path, overwrite)

    def encode(self, batches: Iterator[pa.RecordBatch], sink) -> int:
        total = 0
        for batch in batches:
            column = batch.column("embedding")
            lengths = np.asarray(column.value_lengths())
            if column.null_count or (lengths != self.dim).any():
                raise ValueError(f"every vector must have {self.dim} values")
            sink.write(column.flatten().to_numpy(zero_copy_only=False).astype("<f2").tobytes())
            total += len(batch)
        return total


# --- FASTA in Zstandard frames ------------------------------------------------------------------------


class ZstdFasta(DataSource):
    """``value``: raw records (text up to the next one's ``>``) of ``.zst`` files, for ``parse_records``.

    Files are written as frames of about ``FRAME_BYTES`` of whole records, with the table of frame
    sizes of the seekable layout at their end; frames of such files are read by many tasks. A
    file without that table, of one frame or several, is streamed by one task.
    """

    @classmethod
    def name(cls) -> str:
        return "zstd_fasta"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FrameWriter(self.options["path"], overwrite)


def frame_sizes(path: str, size: int) -> list[int] | None:
    """Compressed sizes of a file's frames from the table at its end, if it has one."""
    if size < 17:
        return None
    n, flags, magic = struct.unpack("<IBI", _bytes(path, size - 9, 9))
    entry = 12 if flags & 0x80 else 8
    start = size - 9 - n * entry - 8
    if magic != SEEKABLE_MAGIC or start < 0:
        return None
    table = _bytes(path, start, size - start)
    if struct.unpack_from("<I", table)[0] != SKIPPABLE_MAGIC:
        return None
    sizes = [struct.unpack_from("<I", table, 8 + k * entry)[0] for k in range(n)]
    return sizes if sum(sizes) == start else None


class _FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = []
        for path, size in _files(self.path, ".zst"):
            sizes = frame_sizes(path, size)
            start, own = 0, 0
            for n in sizes if sizes is not None else [size]:
                if own and own + n > RANGE_BYTES:
                    found.append(_Range(path, start, own))
                    start, own = start + own, 0
                own += n
            if own:
                found.append(_Range(path, start, own))
        return found

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        import zstandard

        if partition is None:
            return
        store, name = file_system(partition.path)
        with store.open_input_file(name) as source:
            source.seek(partition.start)
            limited = _Limited(source, partition.size)
            text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(limited, read_across_frames=True), "utf-8", newline="")
            records, size, rest = [], 0, ""
            while piece := text.read(FRAME_BYTES):
                *whole, rest = (rest + piece).split("\n>")
                records += whole
                size += sum(map(len, whole))
                if size > FRAME_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["value"])
                    records, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([*records, rest], pa.string())], ["value"])


class _Limited(io.RawIOBase):
    """The next ``size`` bytes of a file."""

    def __init__(self, source, size: int):
        self._source, self._left = source, size

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        data = self._source.read(self._left if size < 0 else min(size, self._left))
        self._left -= len(data)
        return data


class _FrameWriter(_FileWriter):
    suffix = ".fa.zst"

    def encode(self, batches: Iterator[pa.RecordBatch], sink) -> int:
        import zstandard

        sizes: list[tuple[int, int]] = []
        waiting, size, total = [], 0, 0

        def flush() -> None:
            plain = "".join(waiting).encode("utf-8", "surrogatepass")
            frame = zstandard.ZstdCompressor().compress(plain)
            sink.write(frame)
            sizes.append((len(frame), len(plain)))
            waiting.clear()

        for batch in batches:
            for record in batch.column("value").to_pylist():
                if record is None:
                    continue
                waiting.append(record if record.endswith("\n") else record + "\n")
                size, total = size + len(record), total + 1
                if size > FRAME_BYTES:
                    flush()
                    size = 0
        if waiting:
            flush()
        table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
        sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        return total
