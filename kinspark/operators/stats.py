"""Sizes of stores and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions.hashing import CORPUS_SHARDS, id_shard
from kinspark.functions.ranges import BUILD_SHARD


def rows_per_shard(df: DataFrame, key: str, shards: int = CORPUS_SHARDS) -> DataFrame:
    """Rows per hash shard, to see skew."""
    return df.groupBy(id_shard(key, shards).alias("shard")).agg(F.count("*").alias("n_rows"))


def store_size(embeddings: DataFrame, shard_size: int = BUILD_SHARD) -> DataFrame:
    """Number of vectors and of range shards (rounded up)."""
    n = F.count("*")
    return embeddings.agg(n.alias("n_vectors"), F.ceil(n / shard_size).cast("long").alias("n_shards"))
