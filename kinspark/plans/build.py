"""Jobs that prepare a searchable store: embeddings and members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions.ranges import range_shard
from kinspark.operators.embed import BATCH_SIZE, Encoder, embed
from kinspark.operators.members import build_members
from kinspark.session import path_is_missing
from kinspark.sources.stores import shard_corpus, write_member_store, write_sharded
from kinspark.sources.vectors import CHUNK_SIZE, read_embeddings, write_embeddings

COMMIT_CHUNKS = 64


def stored_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_embeddings(spark, path)
    except AnalysisException as missing:
        if not path_is_missing(missing):
            raise
        return None


def _per_chunk(rows: DataFrame, chunk_size: int) -> dict[int, int]:
    """Number of keys by chunk: one row per ``chunk_size`` sequences reaches the driver."""
    counts = rows.groupBy(range_shard("centroid_idx", chunk_size).alias("chunk")).agg(F.count("*").alias("n"))
    return {r.chunk: r.n for r in counts.collect()}


def pending_chunks(sequences: DataFrame, store: DataFrame | None, chunk_size: int) -> tuple[list[int], set[int]]:
    """Chunks of keys that are not all stored, and those of them of which something is stored.

    Only keys are counted; texts and vectors are not read.
    """
    wanted = _per_chunk(sequences.where("sequence is not null"), chunk_size)
    stored = _per_chunk(store, chunk_size) if store is not None else {}
    todo = sorted(c for c, n in wanted.items() if stored.get(c, 0) != n)
    return todo, {c for c in todo if stored.get(c, 0)}


def build_index(
    sequences: DataFrame,
    load: Callable[[], Encoder],
    path: str,
    chunk_size: int = CHUNK_SIZE,
    batch_size: int = BATCH_SIZE,
    mode: str = "errorifexists",
    resume: bool = False,
    commit_chunks: int = COMMIT_CHUNKS,
) -> DataFrame:
    """Embed ``centroid_idx, sequence`` into a store and return it.

    The store is committed ``commit_chunks`` chunks of ``chunk_size`` keys at a time, so an
    interrupted build loses one such group at most. With ``resume``, chunks that are stored
    whole are skipped and of others only what is missing is embedded; a finished build does
    nothing. Otherwise ``mode`` decides what happens to an existing store.
    """
    spark = sequences.sparkSession
    rows = sequences.select("centroid_idx", "sequence")
    store = stored_or_none(spark, path) if resume else None
    todo, begun = pending_chunks(rows, store, chunk_size)
    chunk = range_shard("centroid_idx", chunk_size)
    groups = [todo[k : k + commit_chunks] for k in range(0, len(todo), commit_chunks)] or [[]]
    for k, group in enumerate(groups):
        part = rows.where(chunk.isin(group))
        if group:
            # Bounds reach the scan of a store that is sorted by key.
            part = part.where(F.col("centroid_idx").between(group[0] * chunk_size, (group[-1] + 1) * chunk_size - 1))
        elif store is not None:
            break
        if begun & set(group):
            part = part.join(store.where(F.col("chunk").isin(sorted(begun & set(group)))).select("centroid_idx"), "centroid_idx", "left_anti")
        vectors = embed(part, load, batch_size).select("centroid_idx", "embedding")
        write_embeddings(vectors, path, chunk_size, "append" if resume or k else mode)
    return read_embeddings(spark, path)


def build_member_store(
    corpus: DataFrame,
    membership: DataFrame,
    path: str,
    shards: int = 100,
    buckets: int = 512,
    mode: str = "errorifexists",
) -> DataFrame:
    """Prepare ``corpus`` and ``members`` below ``path`` from raw records and the dictionary.

    ``corpus`` has ``name, sequence``, ``membership`` has ``centroid_id, member_id``. Returns
    the member store.
    """
    spark = corpus.sparkSession
    write_sharded(shard_corpus(corpus, shards), f"{path}/corpus", shards, mode=mode)
    proteins = spark.read.parquet(f"{path}/corpus")
    write_member_store(build_members(membership, proteins), f"{path}/members", buckets, mode=mode)
    return spark.read.parquet(f"{path}/members")
