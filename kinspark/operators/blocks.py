"""Block-wise vector arithmetic on Arrow batches, used inside tasks by the joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

SURVIVORS_AT_ONCE = 65_536
# A pair costs about as much alone as this many within a block of products.
DENSE_SHARE, ROWS_AT_ONCE = 32, 512
# Pairs whose vectors are put side by side at once, few enough for a cache.
PAIRS_AT_ONCE = 2_048
# Pairs that a task puts in order before it hands them on.
ORDERED_ROWS = 4 * 1024 * 1024


def vector_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as an ``n x d`` matrix; all vectors must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, 0), dtype=np.float32)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.asarray(column.value_lengths())
    if column.null_count or lengths.min() != lengths.max():
        raise ValueError("embeddings must be non-null vectors of one dimension")
    return flat.reshape(n, -1)


def unit_rows(m: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Rows scaled to unit length; a zero vector stays zero, at distance 1 from everything."""
    m = m.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    norms[norms == 0] = 1.0
    return (m / norms[:, None]).astype(dtype)


def round_distance(d: np.ndarray, digits: int) -> np.ndarray:
    return np.round(d, digits) + 0.0


class VectorBlock:
    """Keyed vectors with single-precision unit forms, and exact ones where needed."""

    def __init__(self, idx: np.ndarray, raw: np.ndarray):
        self.idx, self.raw = idx, raw

    @classmethod
    def from_arrow(cls, batch, key: str) -> "VectorBlock":
        return cls(np.asarray(batch.column(key)), vector_matrix(batch.column("embedding")))

    @cached_property
    def fast(self) -> np.ndarray:
        raw = self.raw.astype(np.float32, copy=False)
        norms = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        norms[norms == 0] = 1.0
        return raw / norms[:, None]

    @cached_property
    def exact(self) -> np.ndarray:
        return unit_rows(self.raw)

    def rows(self, at: np.ndarray) -> "VectorBlock":
        return VectorBlock(self.idx[at], self.raw[at])

    def tiles(self, rows: int):
        for i in range(0, len(self.idx), rows):
            yield VectorBlock(self.idx[i : i + rows], self.raw[i : i + rows])


def pairs_below(corpus: VectorBlock, queries: VectorBlock, cutoff: float, digits: int):
    """Yield ``(corpus rows, query rows, distance)`` of the pairs closer than ``cutoff``.

    A single-precision product, with a margin above its rounding error, finds the
    candidates; their distance is then computed in double precision. The comparison with
    the cutoff is strict and made on the rounded distance.
    """
    d = corpus.fast.shape[1]
    if queries.fast.shape[1] != d:
        raise ValueError(f"dimension mismatch: corpus {d}, queries {queries.fast.shape[1]}")
    # Norms, quotients and the product each add at most about d units of rounding.
    margin = 4.0 * (d + 16) * np.finfo(np.float32).eps + 10.0**-digits
    similar = corpus.fast @ queries.fast.T
    rows, cols = np.nonzero(similar > np.float32(1.0 - cutoff - margin))
    for i in range(0, len(rows), SURVIVORS_AT_ONCE):
        r, c = rows[i : i + SURVIVORS_AT_ONCE], cols[i : i + SURVIVORS_AT_ONCE]
        distance = round_distance(1.0 - _exact_products(corpus, queries, r, c), digits)
        keep = distance < cutoff
        yield r[keep], c[keep], distance[keep]


def _exact_products(corpus: VectorBlock, queries: VectorBlock, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Double-precision products of the unit forms of some pairs, whose rows ascend.

    Where rows are paired with a good part of the queries, whole blocks are multiplied: a
    crowd of near copies costs no more than its rows times the queries.
    """
    own, place = np.unique(rows, return_inverse=True)
    unit = unit_rows(corpus.raw[own])
    if len(rows) * DENSE_SHARE < len(own) * len(queries.idx):
        return by_pair(lambda r, c: np.einsum("ij,ij->i", unit[r], queries.exact[c]), place, cols)
    found = np.empty(len(rows))
    for a in range(0, len(own), ROWS_AT_ONCE):
        first, end = np.searchsorted(place, (a, a + ROWS_AT_ONCE))
        found[first:end] = (unit[a : a + ROWS_AT_ONCE] @ queries.exact.T)[place[first:end] - a, cols[first:end]]
    return found


def by_pair(kernel: Callable, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The numbers that ``kernel`` gives for pairs of rows and columns, worked out a few at a time."""
    found = np.empty(len(rows))
    for i in range(0, len(rows), PAIRS_AT_ONCE):
        found[i : i + PAIRS_AT_ONCE] = kernel(rows[i : i + PAIRS_AT_ONCE], cols[i : i + PAIRS_AT_ONCE])
    return found


def squared_l2(corpus: VectorBlock, queries: VectorBlock, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of some pairs."""

    def kernel(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        diff = corpus.raw[r].astype(np.float64) - queries.raw[c]
        return np.einsum("ij,ij->i", diff, diff)

    return by_pair(kernel, rows, cols)


def smallest_k(distance: np.ndarray, idx: np.ndarray, k: int):
    """Row and column numbers of each column's ``k`` smallest entries, ties by ``idx``."""
    order = np.argsort(idx, kind="stable")
    ordered = distance[order]
    if ordered.shape[0] > k:
        kth = np.partition(ordered, k - 1, axis=0)[k - 1]
        below = ordered < kth
        at = ordered == kth
        room = k - below.sum(axis=0)
        keep = below | (at & (np.cumsum(at, axis=0) <= room))
    else:
        keep = np.ones(ordered.shape, dtype=bool)
    rows, cols = np.nonzero(keep)
    return order[rows], cols


def hits_batch(centroid_idx, query_idx, distance, extra=None) -> pa.RecordBatch:
    arrays = [pa.array(centroid_idx, pa.int64()), pa.array(query_idx, pa.int64()), pa.array(distance, pa.float64())]
    names = ["centroid_idx", "query_idx", "distance"]
    for name, values, kind in extra or []:
        arrays.append(pa.array(values, kind))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def by_distance(batches: Iterator[pa.RecordBatch], rows: int = ORDERED_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, all of whose columns are numbers of eight bytes, in order of distance, ``rows`` at a time.

    Near numbers then stand together, and a file of the rows takes less than half of what it takes
    in order of the keys, in which distances look random.
    """
    held, n, schema = [], 0, None
    for batch in batches:
        if schema is None:
            schema = batch.schema
            held = [np.empty(rows, kind.to_pandas_dtype()) for kind in schema.types]
        at = 0
        while at < batch.num_rows:
            some = min(rows - n, batch.num_rows - at)
            for column, values in zip(held, batch.columns):
                column[n : n + some] = values.to_numpy()[at : at + some]
            n, at = n + some, at + some
            if n == rows:
                yield from _in_order(held, n, schema)
                n = 0
    if n:
        yield from _in_order(held, n, schema)


def _in_order(columns: list[np.ndarray], n: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows by distance, then by squared distance if there is one, both to about six digits."""
    named = dict(zip(schema.names, columns))
    key = (named["distance"][:n] * 2.0**20).astype(np.int64) << 32
    if "squared_l2" in named:
        key += np.minimum(named["squared_l2"][:n] * 2.0**20, 2.0**32 - 1).astype(np.int64)
    order = np.argsort(key)
    del key
    for i in range(0, n, SURVIVORS_AT_ONCE):
        some = order[i : i + SURVIVORS_AT_ONCE]
        yield pa.RecordBatch.from_arrays([pa.array(column[some], kind) for column, kind in zip(columns, schema.types)], schema=schema)
