"""SHA-256 of the values of a group in order, streamed, so that a group of any size takes a few bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_digest(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, separator: str = ",") -> DataFrame:
    """``keys`` and ``name``: the lower-case hex SHA-256 of a group's values (strings), joined by ``separator`` in ``order``.

    Rows are dealt out by key and sorted by Spark, which spills; a task holds one running
    hash and one batch. A null value counts as empty, null keys are a group of their own. Rows
    alike in ``order`` should be alike in ``value`` too, else their order is open. No rows, no groups.
    """
    width = len(keys)
    between = separator.encode()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = None, None
        for batch in batches:
            done: list[tuple] = []
            groups = zip(*(batch.column(k).to_pylist() for k in range(width)))
            for group, text in zip(groups, batch.column(width).to_pylist()):
                if running is not None and group == current:
                    running.update(between)
                else:
                    if running is not None:
                        done.append((*current, running.hexdigest()))
                    current, running = group, hashlib.sha256()
                running.update((text or "").encode("utf-8", "surrogatepass"))
            if done:
                yield _table(done, schema)
        if running is not None:
            yield _table([(*current, running.hexdigest())], schema)

    types = dict(rows.dtypes)
    described = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{name}` string"
    dealt = rows.select(*keys, value, *(c for c in order if c not in keys and c != value)).repartition(*keys)
    schema = pa.schema([pa.field(k, _ARROW[types[k]]) for k in keys] + [pa.field(name, pa.string())])
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(hashed, described)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _table(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
