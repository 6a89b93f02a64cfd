"""Text columns of Arrow batches as arrays: bounded slices, code points, words, 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
HELD_OUT_REMAINDER = 2

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def held_out(key: str = "doc_id") -> Column:
    """True for rows whose labels may never be learnt from: a fixed quarter, by the key's checksum."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def hash_share(key: str, group: str, counts: dict, wanted: int) -> Column:
    """True for a little more than ``wanted`` rows of each group, those with a small hash of their key.

    ``counts`` has the rows of each group. So a sample by rank sorts few rows, however many a
    group has.
    """
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(group) == F.lit(value), F.lit((1.1 * wanted + 100) / max(n, 1))).otherwise(share)
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < share * F.lit(float(1 << 40))


def texts(column: pa.Array) -> pa.Array:
    """The column with null as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, at least one row each, so that work arrays stay small."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, one after the other, and where each row begins and ends in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all rows and the row of each; a zero stands before and after every row."""
    joined = "\0" + "\0".join(x.replace("\0", " ") for x in rows).lower() + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.cumsum(points == 0) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix((np.arange(256, dtype=_U) + _U(1)) * _ODD)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    size = 1 << max(16, int(length).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            table = np.ones(size, _U)
            table[1:] = _U(base)
            tables.append(np.multiply.accumulate(table))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def words(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every row, and the row of each word.

    Words are maximal runs without ASCII white space (tab to carriage return, and space);
    with ``fold`` ASCII capitals count as small letters. The hash depends on the word's bytes alone.
    """
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8) if fold else data
    space = (lower == 32) | ((lower >= 9) & (lower <= 13))
    inside = ~space
    first = np.zeros(len(lower) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= space[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= space[1:] | first[1:-1]
    begins, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _power_tables(len(lower) + 1)
    sums = np.zeros(len(lower) + 1, _U)
    np.cumsum(_BYTE_VALUES[lower] * power[: len(lower)], out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(_U) * _ODD)
    rows = np.searchsorted(offsets, begins, "right") - 1
    return hashes, rows


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For every row the sorted distinct hashes of its ``width``-word shingles.

    A row of fewer words has its whole sequence as one shingle; a row without words an
    empty set.
    """
    hashes, rows = words(column)
    bounds = np.searchsorted(rows, np.arange(len(column) + 1))
    if len(hashes) >= width:
        run = hashes[: len(hashes) - width + 1].copy()
        for k in range(1, width):
            run = mix(run * _ODD + hashes[k : len(hashes) - width + 1 + k])
    else:
        run = np.zeros(0, _U)
    found = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            own = np.sort(run[a : b - width + 1])
            found.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            short = hashes[a]
            with np.errstate(over="ignore"):
                for k in range(a + 1, b):
                    short = mix(short * _ODD + hashes[k])
                found.append(np.array([mix(short * _ODD + _U(b - a))], _U))
        else:
            found.append(np.zeros(0, _U))
    return found
