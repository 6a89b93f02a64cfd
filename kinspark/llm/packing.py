"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinspark.llm.text import slices, texts
from kinspark.llm.tokens import WordEncoder, tokenizer_json

CAPACITY = 4096
GROUP_SEQUENCES = 256
# Bytes of text to encode at once, and to remember of words: few, as workers of other stages stay beside a pipeline's last one.
ENCODED_BYTES = 2 << 20
KEPT_BYTES = 32 << 20
# Attention costs as much as the linear part at this length.
BALANCE_LENGTH = 1024
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def attention_cost(length: int, balance: int = BALANCE_LENGTH) -> float:
    """Linear plus quadratic cost of a piece; pieces of one sequence do not attend to each other."""
    return length + length * length / balance


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Sequence lengths that hold ``total`` tokens without padding.

    Full sequences, and the rest as powers of two (a sequence of such a length is not padded).
    """
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def balance(lengths: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """For every document its pieces as (sequence, length), in order; the sum of ``room`` is that of ``lengths``.

    Documents come by descending length (ties by position). Each goes to the sequence of
    lowest cost that can still take it whole; if none can, it is cut: the cheapest sequence
    with any room takes what fits, and the rest is placed the same way. A part as long as a
    full sequence gets one of its own first, which costs the most anyway.
    """
    room = np.array(room, np.int64)
    cost = np.zeros(len(room))
    full = max(room, default=0)
    whole = [k for k in range(len(room)) if room[k] == full]
    placed: list[list[tuple[int, int]]] = [[] for _ in lengths]
    queue = []
    for k, n in enumerate(lengths):
        while n >= full and whole:
            s = whole.pop(0)
            placed[k].append((s, full))
            room[s], cost[s] = 0, attention_cost(full)
            n -= full
        if n:
            heapq.heappush(queue, (-n, k))
    while queue:
        n, k = heapq.heappop(queue)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        s = int(np.argmin(fits))
        if not np.isfinite(fits[s]):
            s = int(np.argmin(np.where(room > 0, cost, np.inf)))
        taken = min(n, int(room[s]))
        placed[k].append((s, taken))
        room[s] -= taken
        cost[s] += attention_cost(taken)
        if n > taken:
            heapq.heappush(queue, (taken - n, k))
    return placed


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    capacity: int = CAPACITY,
    group_sequences: int = GROUP_SEQUENCES,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents, each followed by ``end_id``, into sequences of at most ``capacity`` ids.

    ``tokenizer`` is the tokenizer's definition (by default the public word tokenizer). Every
    task takes its rows as they come and packs ``group_sequences`` sequences at a time, so
    memory is bounded, nothing is shuffled, and a task that is run again gives the same.
    A document that reaches over the end of a group is cut there; the last group of a task
    ends in sequences of powers of two, so no sequence needs padding.

    Returns one row per piece: the key, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (place in the sequence) and,
    with ``with_ids``, the ``ids``. Null and empty texts have only the end id. Rows with equal
    keys are documents of their own; null keys are kept; an empty table gives no rows. Columns
    of ``docs`` other than the key and the text are not read.
    """
    definition = tokenizer or tokenizer_json()
    if capacity & (capacity - 1) or capacity <= 0:
        raise ValueError("capacity must be a power of two")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {PIECES}" + (", ids array<long>" if with_ids else "")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(definition, KEPT_BYTES)
        first_sequence = TaskContext.get().partitionId() << 32
        limit = capacity * group_sequences
        end = np.array([end_id], "<u4").tobytes()
        group: list[tuple[object, int, int, bytes]] = []  # key, start, all ids of the document, these ids
        held = 0

        def closed() -> pa.RecordBatch:
            nonlocal group, held, first_sequence
            room = capacities(held, capacity)
            out = []
            for (k, start, total, ids), pieces in zip(group, balance([len(g[3]) // 4 for g in group], room)):
                at = 0
                for sequence, length in pieces:
                    own = ids[4 * at : 4 * (at + length)]
                    out.append((sequence, k, start + at, length, zlib.crc32(own), total, own))
                    at += length
            out.sort(key=lambda r: r[0])
            columns: list[list] = [[] for _ in range(8)]
            last, offset = -1, 0
            for sequence, k, start, length, crc, total, own in out:
                offset = 0 if sequence != last else offset
                row = (k, start, length, crc, total, first_sequence + sequence, offset)
                for c, v in zip(columns, row):
                    c.append(v)
                if with_ids:
                    columns[7].append(np.frombuffer(own, "<u4").astype(np.int64))
                last, offset = sequence, offset + length
            first_sequence += len(room)
            group, held = [], 0
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            column = texts(batch.column(1))
            for a, b in slices(column, ENCODED_BYTES):
                keys = batch.column(0).slice(a, b - a).to_pylist()
                for k, ids in zip(keys, encoder.encode(column.slice(a, b - a))):
                    ids += end
                    total, start = len(ids) // 4, 0
                    while ids:
                        part = ids[: 4 * (limit - held)]
                        group.append((k, start, total, part))
                        held += len(part) // 4
                        start += len(part) // 4
                        ids = ids[len(part) :]
                        if held == limit:
                            yield closed()
        if group:
            yield closed()

    return docs.select(key, text).mapInArrow(packed, schema)
