"""Arithmetic on positional keys: range shards and local offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEARCH_SHARD = 100_000
BUILD_SHARD = 10_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def range_shard(idx, size: int = SEARCH_SHARD) -> Column:
    return F.floor(_col(idx) / size).cast("long")


def local_index(idx, size: int = SEARCH_SHARD) -> Column:
    return F.pmod(_col(idx), F.lit(size).cast("long"))


def global_index(shard, local, size: int = SEARCH_SHARD) -> Column:
    return _col(shard) * F.lit(size).cast("long") + _col(local)
