"""Parquet stores laid out by hash, for co-located joins and cheap lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions.hashing import BUCKET_DIRS, CORPUS_SHARDS, bucket_dir, bucket_group, id_shard
from kinspark.functions.headers import record_id, strip_marker, truncate_header
from kinspark.functions.ranges import SEARCH_SHARD, range_shard

MAX_RECORDS_PER_FILE = 2_000_000


def shard_corpus(records: DataFrame, shards: int = CORPUS_SHARDS) -> DataFrame:
    """``name, sequence`` records to ``protein_id, header, sequence, shard``."""
    header = truncate_header(strip_marker("name"))
    keyed = records.select(record_id("name").alias("protein_id"), header.alias("header"), "sequence")
    return keyed.withColumn("shard", id_shard("protein_id", shards))


def write_sharded(df: DataFrame, path: str, n: int = CORPUS_SHARDS, mode: str = "errorifexists") -> None:
    """One compressed folder per id-hash shard.

    Rebalancing splits a crowded shard over several tasks and files, and merges small ones.
    """
    if "shard" not in df.columns:
        df = shard_corpus(df, n)
    balanced = df.hint("rebalance", "shard")
    balanced.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy(
        "shard"
    ).parquet(path)


def with_buckets(df: DataFrame, dirs: int = BUCKET_DIRS) -> DataFrame:
    return df.withColumn("dir", bucket_dir("centroid_id", dirs)).withColumn("grp", bucket_group("centroid_id", dirs))


def write_member_store(df: DataFrame, path: str, buckets: int = 512, mode: str = "errorifexists") -> None:
    """Members in one folder per representative hash, sorted by representative inside files.

    Looking up a few representatives reads only their folders, and row-group statistics
    skip most of those. The members of one very large representative share a folder but
    not a task or a file. The number of folders is kept in the column ``n_dirs``.
    """
    placed = with_buckets(df, buckets).withColumn("n_dirs", F.lit(buckets)).hint("rebalance", "dir").sortWithinPartitions("dir", "centroid_id")
    placed.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy(
        "dir"
    ).parquet(path)


def write_sequences(df: DataFrame, path: str, chunk_size: int = SEARCH_SHARD, mode: str = "errorifexists") -> None:
    """Store ``centroid_idx, name, sequence`` with one folder per range of ``chunk_size`` keys, sorted by key inside.

    The names and texts of a few matched keys are then read from their ranges alone. The chunk
    size is kept in the column ``chunk_size``.
    """
    placed = df.select("centroid_idx", "name", "sequence", F.lit(chunk_size).alias("chunk_size"))
    placed = placed.withColumn("chunk", range_shard("centroid_idx", chunk_size))
    ordered = placed.hint("rebalance", "chunk").sortWithinPartitions("chunk", "centroid_idx")
    ordered.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy(
        "chunk"
    ).parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def matched_chunks(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """A sequence store cut down to the folders of the keys in ``ids``; other tables as they are.

    One value per folder reaches the driver.
    """
    if not {"chunk", "chunk_size"} <= set(sequences.columns):
        return sequences
    first = sequences.select("chunk_size").first()
    if first is None:
        return sequences
    chunks = ids.select(range_shard("centroid_idx", first.chunk_size).alias("chunk")).distinct().collect()
    return sequences.where(F.col("chunk").isin([r.chunk for r in chunks]))


def read_member_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int = 512, mode: str = "errorifexists") -> None:
    """Save as a bucketed, sorted table: joins of two such tables on ``key`` need no exchange."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
