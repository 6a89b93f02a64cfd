"""Hashes that place records in buckets and shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619

# Fixed bucket layout of the member store.
BUCKET_DIRS = 10_000
BUCKET_GROUPS = 1_000

CORPUS_SHARDS = 100


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fnv1a32(text) -> Column:
    """32-bit FNV-1a of an ASCII string, as a non-negative long."""
    s = _col(text)
    codes = F.transform(F.split(s, ""), lambda ch: F.ascii(ch).cast("long"))
    folded = F.aggregate(
        codes,
        F.lit(FNV_OFFSET).cast("long"),
        lambda acc, code: (acc.bitwiseXOR(code) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    return F.when(F.length(s) == 0, F.lit(FNV_OFFSET).cast("long")).otherwise(folded)


def bucket_dir(centroid_id, dirs: int = BUCKET_DIRS) -> Column:
    return F.pmod(fnv1a32(centroid_id), F.lit(dirs)).cast("int")


def bucket_group(centroid_id, dirs: int = BUCKET_DIRS, groups: int = BUCKET_GROUPS) -> Column:
    return F.pmod(F.floor(fnv1a32(centroid_id) / dirs), F.lit(groups)).cast("int")


def id_shard(record_id, shards: int = CORPUS_SHARDS) -> Column:
    """Hash shard of an id: equal ids land in equal shards on every table."""
    return F.pmod(F.xxhash64(_col(record_id)), F.lit(shards)).cast("int")


def text_key(text) -> Column:
    """Fixed-width identity of a long text, to group and join on without shuffling the text."""
    return F.unhex(F.sha2(_col(text), 256))
