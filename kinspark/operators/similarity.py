"""Exact similarity joins and nearest neighbours by cosine distance.

A query set of checked, bounded size is sent to every task and the corpus is scanned once,
without a shuffle. A larger query set is joined by cells (``operators.cells``): both sides
are distributed, and only cells that can hold a hit are visited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.functions.ranges import SEARCH_SHARD, range_shard
from kinspark.operators.blocks import VectorBlock, hits_batch, pairs_below, round_distance, smallest_k, squared_l2, vector_matrix

COSINE_CUTOFF = 0.2
DISTANCE_DIGITS = 6
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
QUERIES_PER_TILE = 1024
CANDIDATE_BYTES = 64 * 1024 * 1024

# Fixed schedules of the neighbour count: first count, doubled up to ten times.
DEEPENING_START_EXACT = 20
DEEPENING_ROUNDS = 10

HITS_SCHEMA = "centroid_idx long, query_idx long, distance double"


def below_cutoff(distance, cutoff: float = COSINE_CUTOFF) -> Column:
    """Strict distance cutoff."""
    return (F.col(distance) if isinstance(distance, str) else distance) < F.lit(cutoff)


def vector_bytes(queries: DataFrame) -> tuple[int, int]:
    """Number of query vectors and the bytes a task needs to hold them in all their forms."""
    n, d = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    return n, n * (d or 0) * (4 + 8 + 4)


def fits_broadcast(queries: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> bool:
    return vector_bytes(queries)[1] <= limit


def broadcast_vectors(queries: DataFrame):
    """Ship a query set, already checked to be small, to every task."""
    table = queries.select(F.col("query_idx").cast("long"), F.col("embedding").cast("array<float>")).toArrow()
    idx = table.column("query_idx").to_numpy()
    return queries.sparkSession.sparkContext.broadcast((idx, vector_matrix(table.column("embedding"))))


def _corpus_columns(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("centroid_idx").cast("long"), F.col("embedding").cast("array<float>")).where(
        "embedding is not null"
    )


def similarity_join(
    queries: DataFrame,
    corpus: "DataFrame | CellIndex",
    cutoff: float = COSINE_CUTOFF,
    digits: int = DISTANCE_DIGITS,
    with_squared_l2: bool = False,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """All pairs with cosine distance below ``cutoff``: ``centroid_idx, query_idx, distance``.

    ``queries`` has ``query_idx, embedding``, ``corpus`` has ``centroid_idx, embedding`` or is a
    stored index by cell, of which only cells that can hold a hit are read.
    With ``with_squared_l2`` the squared Euclidean distance of the vectors is added.
    """
    queries = queries.select("query_idx", "embedding").where("embedding is not null")
    if not isinstance(corpus, DataFrame) or not fits_broadcast(queries, max_broadcast_bytes):
        from kinspark.operators.cells import cell_join

        return cell_join(queries, corpus, cutoff, digits, with_squared_l2)
    return _scan_join(queries, corpus, cutoff, digits, with_squared_l2)


def _scan_join(queries, corpus, cutoff, digits, with_squared_l2) -> DataFrame:
    shared = broadcast_vectors(queries)

    def search(batches):
        tiles = list(VectorBlock(*shared.value).tiles(QUERIES_PER_TILE)) if len(shared.value[0]) else []
        for batch in batches:
            if not tiles or batch.num_rows == 0:
                continue
            block = VectorBlock.from_arrow(batch, "centroid_idx")
            for tile in tiles:
                yield from hit_batches(block, tile, cutoff, digits, with_squared_l2)

    return _corpus_columns(corpus).mapInArrow(search, hits_schema(with_squared_l2))


def hits_schema(with_squared_l2: bool) -> str:
    return HITS_SCHEMA + (", squared_l2 double" if with_squared_l2 else "")


def hit_batches(block: VectorBlock, tile: VectorBlock, cutoff: float, digits: int, with_squared_l2: bool):
    for rows, cols, distance in pairs_below(block, tile, cutoff, digits):
        if len(rows) == 0:
            continue
        extra = []
        if with_squared_l2:
            extra = [("squared_l2", round_distance(squared_l2(block, tile, rows, cols), digits), pa.float64())]
        yield hits_batch(block.idx[rows], tile.idx[cols], distance, extra)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    shard_size: int = SEARCH_SHARD,
    digits: int = DISTANCE_DIGITS,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` nearest entries of each range shard for each query, ties by key.

    Returns ``query_idx, shard, centroid_idx, distance, rank``. Each task keeps only its
    own ``k`` best per query and shard before the final ranking.
    """
    queries = queries.select("query_idx", "embedding").where("embedding is not null")
    if fits_broadcast(queries, max_broadcast_bytes):
        candidates = _scan_nearest(queries, corpus, k, shard_size, digits)
    else:
        from kinspark.operators.cells import cell_nearest

        candidates, _ = cell_nearest(queries, corpus, k, shard_size, digits)
    best = Window.partitionBy("query_idx", "shard").orderBy("distance", "centroid_idx")
    ranked = candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_idx", "shard", "centroid_idx", "distance", "rank")


NEAREST_SCHEMA = HITS_SCHEMA + ", shard long"


def nearest_batches(block: VectorBlock, tile: VectorBlock, k: int, shard_size: int, digits: int, best: dict | None):
    """Best candidates of one block; merged into ``best`` when that is given, else yielded."""
    distance = round_distance(1.0 - block.exact @ tile.exact.T, digits)
    shards = block.idx // shard_size
    for shard in np.unique(shards):
        inside = shards == shard
        d, idx = distance[inside], block.idx[inside]
        rows, cols = smallest_k(d, idx, k)
        found = (idx[rows], cols, d[rows, cols])
        if best is None:
            yield hits_batch(found[0], tile.idx[cols], found[2], [("shard", np.full(len(rows), shard), pa.int64())])
        else:
            key = (int(shard), id(tile))
            kept = best.get(key)
            best[key] = (tile, _merge(kept[1], found, k) if kept else found)


def _merge(a, b, k: int):
    idx, cols, d = (np.concatenate(pair) for pair in zip(a, b))
    order = np.lexsort((idx, d, cols))
    cols_sorted = cols[order]
    starts = np.r_[0, np.flatnonzero(np.diff(cols_sorted)) + 1]
    sizes = np.diff(np.r_[starts, len(order)])
    position = np.arange(len(order)) - np.repeat(starts, sizes)
    keep = order[position < k]
    return idx[keep], cols[keep], d[keep]


def flush_best(best: dict):
    for (shard, _), (tile, (idx, cols, d)) in best.items():
        yield hits_batch(idx, tile.idx[cols], d, [("shard", np.full(len(idx), shard), pa.int64())])
    best.clear()


def _scan_nearest(queries, corpus, k, shard_size, digits) -> DataFrame:
    shared = broadcast_vectors(queries)

    def search(batches):
        tiles = list(VectorBlock(*shared.value).tiles(QUERIES_PER_TILE)) if len(shared.value[0]) else []
        best: dict = {}
        for batch in batches:
            if not tiles or batch.num_rows == 0:
                continue
            block = VectorBlock.from_arrow(batch, "centroid_idx")
            for tile in tiles:
                yield from nearest_batches(block, tile, k, shard_size, digits, best)
            if sum(len(found[0]) for _, found in best.values()) * 24 > CANDIDATE_BYTES:
                yield from flush_best(best)
        yield from flush_best(best)

    return _corpus_columns(corpus).mapInArrow(search, NEAREST_SCHEMA)


def coverage(neighbours: DataFrame, k: int, cutoff: float = COSINE_CUTOFF) -> DataFrame:
    """Per query and shard: the farthest returned distance, and whether ``k`` ended inside the cutoff."""
    return neighbours.groupBy("query_idx", "shard").agg(
        F.max("distance").alias("max_distance"),
        F.count("*").alias("n_returned"),
        ((F.count("*") >= k) & (F.max("distance") < cutoff)).alias("saturated"),
    )


def deepening_report(
    hits: DataFrame, shard_size: int = SEARCH_SHARD, start: int = DEEPENING_START_EXACT, rounds: int = DEEPENING_ROUNDS
) -> DataFrame:
    """Rounds of doubling ``k`` that a top-k index would need to cover the cutoff.

    The threshold join finds all hits in one pass; per query and shard this gives the
    number of rounds and the final ``k`` of the equivalent deepening search, and whether
    its last round would have been deep enough.
    """
    per_shard = hits.groupBy("query_idx", range_shard("centroid_idx", shard_size).alias("shard")).agg(
        F.count("*").alias("n_hits")
    )
    # Round n returns start * 2^n neighbours and is enough once that exceeds the hits.
    enough = F.lit(rounds)
    for n in range(rounds - 1, 0, -1):
        enough = F.when(F.col("n_hits") < start * 2**n, F.lit(n)).otherwise(enough)
    return per_shard.select(
        "query_idx",
        "shard",
        "n_hits",
        enough.alias("rounds"),
        (F.lit(start) * F.pow(F.lit(2), enough)).cast("long").alias("k"),
        (F.col("n_hits") < start * 2**rounds).alias("complete"),
    )
