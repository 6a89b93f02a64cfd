"""Token ids in length-delimited binary files with checksums, and an offset index beside each."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinspark.llm.text import slices, texts
from kinspark.llm.tokens import ENCODED_BYTES, shared_encoder, tokenizer_json
from kinspark.sources.files import file_system

# Fixed values of the record format: polynomial of the checksum, and its mask.
CASTAGNOLI = 0x82F63B78
MASK_DELTA = 0xA282EAD8
# A record: length (8 bytes), masked checksum of the length (4), data, masked checksum of the data (4).
HEADER, FOOTER = 12, 4
ID_BYTES = {2: "<u2", 4: "<u4"}

_SPAN = 1024


def _byte_tables() -> np.ndarray:
    """What a byte adds to the checksum, by the number of bytes that follow it in its span."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1)
    tables = np.zeros((_SPAN, 256), np.uint32)
    tables[0] = table
    for k in range(1, _SPAN):
        tables[k] = (tables[k - 1] >> 8) ^ table[tables[k - 1] & 255]
    return tables


_TABLES = _byte_tables()
_FLAT = _TABLES.ravel()
_ROW = np.arange(_SPAN - 1, -1, -1) * 256


def crc32c(data: bytes) -> int:
    """The Castagnoli checksum; the remainder is carried from span to span in its first four bytes."""
    state = 0xFFFFFFFF
    for at in range(0, len(data), _SPAN):
        span = np.frombuffer(data, np.uint8, min(_SPAN, len(data) - at), at)
        if len(span) < 4:
            for byte in span.tolist():
                state = (state >> 8) ^ int(_TABLES[0, (state ^ byte) & 255])
            continue
        index = _ROW[_SPAN - len(span) :] + span
        index[:4] = _ROW[_SPAN - len(span) :][:4] + (span[:4] ^ np.frombuffer(struct.pack("<I", state), np.uint8))
        state = int(np.bitwise_xor.reduce(_FLAT[index]))
    return state ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    crc = crc32c(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def framed(data: bytes) -> bytes:
    """One record."""
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))))


def unframed(record: bytes) -> bytes:
    """The data of a record, whose length and checksums must be right."""
    size, crc = struct.unpack_from("<QI", record)
    if masked(record[:8]) != crc or len(record) != HEADER + size + FOOTER:
        raise ValueError("damaged record length")
    data = record[HEADER : HEADER + size]
    if masked(data) != struct.unpack_from("<I", record, HEADER + size)[0]:
        raise ValueError("damaged record")
    return data


def write_records(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Encode whole texts and write them below ``path`` in ascending order of ``key``; returns the index.

    Each task encodes one range of keys and writes one file of framed records, of ids in two
    bytes if the vocabulary allows, else four. ``path`` must be one that every executor can
    reach. A file is written under a name of its attempt and moved when complete, so a task
    that is run again does no harm. The index, written as Parquet in ``path``/index, has one
    row per document: the key, ``part``, ``row`` (its place in the file), ``offset``, ``bytes``
    of the record, ``ids_before`` (in the file), ``n_tokens`` with the end id.

    Null and empty texts have only the end id; null keys come first; equal keys are separate
    documents, ordered by text. An empty table gives an empty index and no files. Other columns
    are not read.
    """
    definition = tokenizer or tokenizer_json()
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, part int, row long, offset long, bytes long, ids_before long, n_tokens long, id_bytes int"
    path = path.rstrip("/")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(key, text).repartitionByRange(n, key).sortWithinPartitions(key, text)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(definition)
        width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
        context = TaskContext.get()
        part = context.partitionId()
        store, folder = file_system(path)
        store.create_dir(folder, recursive=True)
        own = f"{folder}/.part-{part:06d}-{context.taskAttemptId()}"
        end = np.array([end_id], "<u4").tobytes()
        out, offset, row, ids_so_far = None, 0, 0, 0
        for batch in batches:
            column = texts(batch.column(1))
            for a, b in slices(column, ENCODED_BYTES):
                sizes, counts, offsets, before = [], [], [], []
                for ids in encoder.encode(column.slice(a, b - a)):
                    record = framed(np.frombuffer(ids + end, "<u4").astype(ID_BYTES[width]).tobytes())
                    if out is None:
                        out = store.open_output_stream(own)
                    out.write(record)
                    offsets.append(offset)
                    sizes.append(len(record))
                    counts.append(len(ids) // 4 + 1)
                    before.append(ids_so_far)
                    ids_so_far += counts[-1]
                    offset += len(record)
                m = b - a
                arrays = [
                    batch.column(0).slice(a, m), pa.array([part] * m, pa.int32()), pa.array(range(row, row + m), pa.int64()),
                    *(pa.array(v, pa.int64()) for v in (offsets, sizes, before, counts)), pa.array([width] * m, pa.int32()),
                ]
                row += m
                yield pa.RecordBatch.from_arrays(arrays, [key, "part", "row", "offset", "bytes", "ids_before", "n_tokens", "id_bytes"])
        if out is not None:
            out.close()
            store.move(own, f"{folder}/part-{part:06d}.rec")

    ordered.mapInArrow(write, schema).write.parquet(f"{path}/index")
    return spark.read.schema(schema).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, index: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of an index, in any order and selection, from their files; checksums are verified.

    Returns the key, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``
    (of its ids as unsigned 32-bit integers) and, with ``with_ids``, the ``ids``. ``start`` is
    the index's count within the file plus the ids of the files before it, of which there is
    one total per file.
    """
    path = path.rstrip("/")
    kind = index.schema[key].dataType.simpleString()
    whole = spark.read.schema(index.schema).parquet(f"{path}/index")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = whole.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    placed = index.join(files, "part").withColumn("start", F.col("ids_before") + F.col("_base"))
    schema = f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        part, source = None, None
        for batch in batches:
            keys, starts, counts, crcs, ids = [], [], [], [], []
            for r in batch.to_pylist():
                if r["part"] != part:
                    if source is not None:
                        source.close()
                    part, source = r["part"], store.open_input_file(f"{folder}/part-{r['part']:06d}.rec")
                source.seek(r["offset"])
                own = np.frombuffer(unframed(source.read(r["bytes"])), ID_BYTES[r["id_bytes"]]).astype("<u4")
                if len(own) != r["n_tokens"]:
                    raise ValueError("index and file differ")
                keys.append(r[key])
                starts.append(r["start"])
                counts.append(len(own))
                crcs.append(zlib.crc32(own.tobytes()))
                if with_ids:
                    ids.append(own.astype(np.int64))
            arrays = [pa.array(keys, batch.schema.field(key).type), *(pa.array(v, pa.int64()) for v in (starts, counts, crcs))]
            names = [key, "start", "n_tokens", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        if source is not None:
            source.close()

    return placed.select(key, "part", "offset", "bytes", "n_tokens", "id_bytes", "start").mapInArrow(read, schema)
