"""Relational steps on hits: names, filters, orders, distinct sets and reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.functions.headers import fallback_query_name, record_id, strip_marker
from kinspark.functions.ranges import SEARCH_SHARD, range_shard
from kinspark.operators.skew import restrict, salted_join
from kinspark.session import counted_table, through_table
from kinspark.sources.stores import matched_chunks


def attach_sequences(hits: DataFrame, sequences: DataFrame) -> DataFrame:
    """Hits with ``centroid_name, sequence``; hits without a stored sequence are dropped.

    The hits are worked out once and written; the sequence store is cut down to the matched
    entries before it is joined, and of a store written by ``write_sequences`` only the folders
    of matched entries are read.
    """
    hits = through_table(hits, "hits")
    stored = matched_chunks(sequences, hits).select("centroid_idx", strip_marker("name").alias("centroid_name"), "sequence")
    return hits.join(restrict(stored, hits, "centroid_idx"), "centroid_idx")


def attach_query_names(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with ``query_name``. One query may own most of the hits, so its rows are spread."""
    names = queries.select("query_idx", fallback_query_name("query_name", "query_idx").alias("query_name"))
    return salted_join(hits, names, "query_idx", spread=F.col("centroid_idx"))


def name_hits(hits: DataFrame, sequences: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_name, centroid_name, sequence, distance`` of every hit that has a sequence."""
    named = attach_query_names(hits, queries)
    return attach_sequences(named, sequences).select("query_name", "centroid_name", "sequence", "distance")


def filter_aligned(named_hits: DataFrame, aligned: DataFrame) -> DataFrame:
    """Hits whose representative is in ``aligned`` (``centroid_id``)."""
    ids = aligned.select("centroid_id").distinct()
    keyed = named_hits.withColumn("centroid_id", record_id("centroid_name"))
    return salted_join(keyed, ids, "centroid_id", "left_semi").drop("centroid_id")


def distinct_centroid_sequences(named_hits: DataFrame) -> DataFrame:
    return named_hits.select("centroid_name", "sequence").distinct()


def distinct_centroids(named_hits: DataFrame) -> DataFrame:
    return named_hits.select(record_id("centroid_name").alias("centroid_id")).distinct()


def distinct_matches(hits: DataFrame) -> DataFrame:
    return hits.select("centroid_idx").distinct()


def matches_per_shard(hits: DataFrame, shard_size: int = SEARCH_SHARD) -> DataFrame:
    """Distinct matched entries per range shard.

    Deduplicated by key first, so a single crowded shard is counted by many tasks.
    """
    return (
        distinct_matches(hits)
        .groupBy(range_shard("centroid_idx", shard_size).alias("shard"))
        .agg(F.count("*").alias("n_matches"))
    )


def hits_by_centroid(hits: DataFrame) -> DataFrame:
    """Per matched entry, its ``(query_idx, distance)`` pairs in order of query.

    A list is as long as the number of queries that hit the entry.
    """
    pair = F.struct("query_idx", "distance")
    return hits.groupBy("centroid_idx").agg(F.sort_array(F.collect_list(pair)).alias("matches"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """One row per stage with its number of rows, counted where the data is."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows") for name, df in stages.items()]
    return reduce(DataFrame.unionByName, counts)


def staged(spark: SparkSession, stages: list[tuple[str, Callable[..., DataFrame]]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables of a chain of steps, each written once, and ``stage, n_rows`` as observed while writing.

    A step takes the tables before it, by name, and returns its own; no step runs a second
    time, neither for its count nor for the steps after it.
    """
    tables: dict[str, DataFrame] = {}
    counts = []
    for name, step in stages:
        tables[name], n = counted_table(step(**tables), name)
        counts.append((name, n))
    return tables, spark.createDataFrame(counts, "stage string, n_rows long")


def sort_hits(hits: DataFrame) -> DataFrame:
    return hits.orderBy("centroid_idx", "query_idx")


def sort_named_hits(named_hits: DataFrame) -> DataFrame:
    return named_hits.orderBy("query_name", "distance", "centroid_name")


def sort_by_centroid(named_hits: DataFrame) -> DataFrame:
    return named_hits.orderBy("centroid_name", "sequence", "query_name")


def differences(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that ``left`` has more often than ``right``, and the other way round, each as often as it has more of it.

    What ``exceptAll`` gives both ways, with one shuffle of the rows; only rows that differ are written.
    """
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    differ = through_table(signed.groupBy(*left.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0"), "differences")
    repeated = differ.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.abs("_n"))))
    return repeated.where("_n > 0").select(*left.columns), repeated.where("_n < 0").select(*left.columns)


def union_hits(*parts: DataFrame) -> DataFrame:
    """All hits of several stores."""
    return reduce(DataFrame.unionByName, parts)


def top_hit_per_target(alignments: DataFrame) -> DataFrame:
    """Best alignment of each target: lowest E-value, then highest score, then query."""
    best = Window.partitionBy("target").orderBy("evalue", F.desc("bitscore"), "query", "target_start", "query_start")
    return alignments.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def ids_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return restrict(df, ids, key)


def ids_not_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return salted_join(df, ids.select(key).distinct(), key, "left_anti")
