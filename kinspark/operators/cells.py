"""Cell-wise vector joins for query sets of any size, and the approximate join.

Every corpus vector belongs to the cell of its nearest pivot. By the triangle inequality
for angles, a query can only have a hit in a cell if its angle to the pivot is at most the
cell's radius plus the cutoff's angle; the exact join visits those cells, the approximate
join the few nearest ones. The corpus is laid out by cell once. A query set of any size is cut
into tiles of neighbouring queries, which the threshold join's tasks read in turn for each
stretch of the corpus, and which the nearest-neighbour search sends to every task in turn: nothing
of the corpus is shuffled or repeated for a tile, and a cell with a third of all rows is many splits of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.operators.blocks import SURVIVORS_AT_ONCE, VectorBlock, by_distance, hits_batch, round_distance, unit_rows, vector_matrix
from kinspark.operators.similarity import (
    COSINE_CUTOFF,
    DISTANCE_DIGITS,
    MAX_BROADCAST_BYTES,
    NEAREST_SCHEMA,
    QUERIES_PER_TILE,
    broadcast_vectors,
    hit_batches,
    hits_schema,
    vector_bytes,
)
from kinspark.session import scratch_path, through_table
from kinspark.sources.files import file_system

MAX_PIVOTS = 1024
# Rows per wanted neighbour that the nearest cells should hold, over all shards.
NEAR_ROWS = 4
# Covers the rounding of double-precision angles, which is largest near zero (about 2e-8).
ANGLE_MARGIN = 1e-6
# Bytes per query and pivot while cells are chosen: an angle, a position, a flag.
CHOICE_BYTES = 8 + 8 + 1
# Vectors of the corpus that a task holds while tiles of queries pass.
STRETCH_BYTES = 16 * 1024 * 1024


def choose_pivots(corpus: DataFrame, pivots: int, seed: int = 0) -> np.ndarray:
    """Unit pivots: the ``pivots`` distinct corpus vectors with the smallest key hash.

    They are held by the driver, so more than ``MAX_PIVOTS`` are refused.
    """
    if not 0 < pivots <= MAX_PIVOTS:
        raise ValueError(f"between 1 and {MAX_PIVOTS} pivots are supported, not {pivots}")
    known = corpus.where("embedding is not null")
    # Keys alone are ranked; then the chosen rows' vectors are fetched.
    keys = known.select("centroid_idx", F.xxhash64("centroid_idx", F.lit(seed)).alias("h")).orderBy("h", "centroid_idx").limit(pivots)
    chosen = known.join(F.broadcast(keys.select("centroid_idx")), "centroid_idx", "left_semi")
    table = chosen.select(F.col("embedding").cast("array<float>")).toArrow()
    if table.num_rows == 0:
        return np.empty((0, 0), dtype=np.float32)
    return np.unique(unit_rows(vector_matrix(table.column("embedding")), np.float32), axis=0)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between vectors and pivots (vectors x pivots) in double precision."""
    similar = unit_rows(vectors, np.float64) @ unit_rows(pivots, np.float64).T
    return np.arccos(np.clip(similar, -1, 1))


def largest_angle(cutoff: float, digits: int) -> float:
    """Largest angle of a pair whose rounded distance is below ``cutoff``."""
    return float(np.arccos(np.clip(1.0 - cutoff - 0.5 * 10.0**-digits, -1, 1)))


def assign_cells(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``angle`` (to that pivot) to ``centroid_idx, embedding``.

    Single precision chooses the cell; the angle, from which radii follow, is that of the
    difference of double-precision unit rows, which is exact to the last digits near zero.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            raw = vector_matrix(batch.column("embedding"))
            cell = (unit_rows(raw, np.float32) @ shared.value.T).argmax(axis=1)
            unit, own = unit_rows(raw, np.float64), unit_rows(shared.value, np.float64)[cell]
            apart = 2 * np.arcsin(np.clip(np.linalg.norm(unit - own, axis=1) / 2, 0, 1))
            # A zero vector is at distance 1 from everything.
            angle = np.where(unit.any(axis=1), apart, np.pi / 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], [*batch.schema.names, "cell", "angle"]
            )

    narrow = corpus.select(F.col("centroid_idx").cast("long"), F.col("embedding").cast("array<float>"))
    return narrow.where("embedding is not null").mapInArrow(
        assign, "centroid_idx long, embedding array<float>, cell int, angle double"
    )


def _wanted_cells(vectors: np.ndarray, pivots: np.ndarray, radius, max_angle, probes) -> np.ndarray:
    """Which cells each query has to visit (queries x pivots).

    ``probes`` cells are chosen by angle alone; cells without rows, or too far to hold a hit,
    are ruled out afterwards. So what is found does not depend on whether radii are known.
    """
    angle = _angles(vectors, pivots)
    wanted = np.ones(angle.shape, dtype=bool)
    if probes is not None and probes < len(pivots):
        near = np.argpartition(angle, probes - 1, axis=1)[:, :probes]
        wanted[:] = False
        np.put_along_axis(wanted, near, True, axis=1)
    if radius is not None:
        wanted &= radius >= 0
        if max_angle is not None:
            wanted &= angle - radius <= max_angle + ANGLE_MARGIN
    return wanted


def _meetings(block: VectorBlock, cells: np.ndarray, everything: VectorBlock, wanted: np.ndarray, per_cell: dict, kernel):
    """What ``kernel`` gives for the vectors of every cell in a block and the queries that want it, which ``per_cell`` keeps for the next block."""
    for cell in np.unique(cells):
        if cell not in per_cell:
            at = np.flatnonzero(wanted[:, cell])
            per_cell[cell] = at, everything.rows(at)
        at, own = per_cell[cell]
        part = block.rows(np.flatnonzero(cells == cell)) if len(at) else block
        for i, tile in enumerate(own.tiles(QUERIES_PER_TILE)):
            yield from kernel(part, tile, at[i * QUERIES_PER_TILE : (i + 1) * QUERIES_PER_TILE])


def _scan_of_tiles(index: "CellIndex", dealt: DataFrame, path: str, wants, kernel, schema: str) -> DataFrame:
    """``_visited_rows`` for all tiles of queries (stored below ``path``) in one scan, of which nothing is kept.

    A task holds a stretch of the corpus while it reads the tiles one after the other, so
    neither the driver nor a task has more than one tile.
    """
    tiles = sorted(r["tile"] for r in dealt.select("tile").distinct().collect())  # one value a folder

    def found(batches):
        store, folder = file_system(path)
        for blocks in _stretches(batches):
            for number in tiles:
                table = pq.read_table(f"{folder}/tile={number}", columns=["query_idx", "embedding"], filesystem=store, partitioning=None)
                everything = VectorBlock(table.column("query_idx").to_numpy(), vector_matrix(table.column("embedding")))
                wanted, per_cell = wants(everything.raw), {}
                for block, cells in blocks:
                    yield from _meetings(block, cells, everything, wanted, per_cell, kernel)

    return index.vectors.select("centroid_idx", "embedding", "cell").mapInArrow(lambda batches: by_distance(found(batches)), schema)


def _stretches(batches) -> Iterator[list[tuple[VectorBlock, np.ndarray]]]:
    """Vectors and cells of successive batches, about ``STRETCH_BYTES`` at once."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            block = VectorBlock.from_arrow(batch, "centroid_idx")
            held.append((block, np.asarray(batch.column("cell"))))
            size += block.raw.nbytes
        if size >= STRETCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _visited_rows(index: "CellIndex", shared_queries, wanted: np.ndarray, kernel, schema: str) -> DataFrame:
    """Rows of ``kernel(block, queries, positions)`` for the vectors of every wanted cell and the queries that want it.

    Cells that no query wants are not read. ``positions`` are those of the queries in the tile.
    """
    visited = [int(c) for c in np.flatnonzero(wanted.any(axis=0))]
    spark = index.vectors.sparkSession
    shared_wanted = spark.sparkContext.broadcast(wanted)

    def found(batches):
        everything = VectorBlock(*shared_queries.value)
        per_cell: dict = {}
        for batch in batches:
            if batch.num_rows:
                yield from _meetings(VectorBlock.from_arrow(batch, "centroid_idx"), np.asarray(batch.column("cell")), everything, shared_wanted.value, per_cell, kernel)

    source = index.vectors.where(F.col("cell").isin(visited))
    return source.select("centroid_idx", "embedding", "cell").mapInArrow(lambda batches: by_distance(found(batches)), schema)


def _laid_out(corpus: "DataFrame | CellIndex", pivots: int, seed: int) -> "CellIndex | None":
    """The corpus by cell: as stored, or written to the shared folder now. Nothing if it has no vectors."""
    if isinstance(corpus, CellIndex):
        return corpus
    path = scratch_path(corpus.sparkSession, "cells")
    return load_cell_index(corpus.sparkSession, path) if _write_cells(corpus, path, pivots, seed, "errorifexists") else None


def _n_tiles(queries: DataFrame, pivots: np.ndarray, max_bytes: int) -> int:
    n, size = vector_bytes(queries)
    return -(-(size + n * len(pivots) * CHOICE_BYTES) // max_bytes)


def _dealt(queries: DataFrame, pivots: np.ndarray, parts: int) -> DataFrame:
    """The query set with a ``tile`` for each row."""
    placed = assign_cells(queries.withColumnRenamed("query_idx", "centroid_idx"), pivots).withColumnRenamed("centroid_idx", "query_idx")
    return placed.repartitionByRange(parts, "cell", "angle", "query_idx").withColumn("tile", F.spark_partition_id())


def query_tiles(queries: DataFrame, pivots: np.ndarray, max_bytes: int) -> Iterator[DataFrame]:
    """The query set in parts of about ``max_bytes``, near queries together, so that a part wants few cells."""
    parts = _n_tiles(queries, pivots, max_bytes)
    if parts <= 1:
        yield queries
        return
    dealt = through_table(_dealt(queries, pivots, parts), "query-tiles")
    for tile in range(parts):
        yield dealt.where(F.col("tile") == tile).select("query_idx", "embedding")


def cell_join(
    queries: DataFrame,
    corpus: "DataFrame | CellIndex",
    cutoff: float = COSINE_CUTOFF,
    digits: int = DISTANCE_DIGITS,
    with_squared_l2: bool = False,
    pivots: int | None = None,
    probes: int | None = None,
    seed: int = 0,
    max_tile_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Threshold join of a query set of any size; exact unless ``probes`` limits the cells visited.

    Only the vectors are laid out. Hits, which may grow with the square of the input, are not written: they come out of the last scan.
    """
    schema = hits_schema(with_squared_l2)
    spark = queries.sparkSession
    index = _laid_out(corpus, pivots or 256, seed)
    if index is None:
        return _none(spark, schema)
    max_angle = largest_angle(cutoff, digits)

    def kernel(block, tile, _):
        return hit_batches(block, tile, cutoff, digits, with_squared_l2)

    def wants(vectors: np.ndarray) -> np.ndarray:
        return _wanted_cells(vectors, pivots_of, radius, max_angle, probes)

    pivots_of, radius = index.pivots, index.radius
    queries = queries.select("query_idx", "embedding").where("embedding is not null")
    parts = _n_tiles(queries, index.pivots, max_tile_bytes)
    if parts > 1:
        path = scratch_path(spark, "query-tiles")
        _dealt(queries, index.pivots, parts).write.partitionBy("tile").parquet(path)
        return _scan_of_tiles(index, spark.read.parquet(path), path, wants, kernel, schema)
    shared = broadcast_vectors(queries)
    if not len(shared.value[0]):
        return _none(spark, schema)
    return _visited_rows(index, shared, wants(shared.value[1]), kernel, schema)


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


VISITS_SCHEMA = "query_idx long, near_cells long, further_cells long, all_cells long"


def cell_nearest(
    queries: DataFrame, corpus: "DataFrame | CellIndex", k: int, shard_size: int, digits: int, pivots: int = 256, max_tile_bytes: int = MAX_BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Candidates for the ``k`` nearest per query and range shard, and how many cells each query visited.

    First every query visits its nearest cells, until they hold ``NEAR_ROWS`` times ``k`` rows a
    shard. The largest of its k-th distances over all shards then bounds what it still needs, and it visits the further
    cells whose angle less radius is within that bound; a query with too few rows of some
    shard has no bound and visits all. Candidates include the ``k`` nearest of every shard, whatever the bounds.
    """
    spark = queries.sparkSession
    index = _laid_out(corpus, pivots, 0)
    if index is None:
        return _none(spark, NEAREST_SCHEMA), _none(spark, VISITS_SCHEMA)
    shard = F.floor(F.col("centroid_idx") / shard_size).cast("long").alias("shard")
    shards = through_table(index.vectors.groupBy(shard).agg(F.least(F.count("*"), F.lit(k)).alias("needed")), "shard-sizes")
    n_shards = shards.count()
    path, visits = scratch_path(spark, "nearest"), scratch_path(spark, "visits")
    _none(spark, VISITS_SCHEMA).write.parquet(visits)
    _none(spark, NEAREST_SCHEMA).write.parquet(path)

    def kernel(bounds: np.ndarray | None):
        def near(block, tile, positions):
            distance = round_distance(1.0 - block.exact @ tile.exact.T, digits)
            good = np.isfinite(distance) if bounds is None else distance <= bounds[positions]
            rows, cols = np.nonzero(good)
            for i in range(0, len(rows), SURVIVORS_AT_ONCE):
                r, c = rows[i : i + SURVIVORS_AT_ONCE], cols[i : i + SURVIVORS_AT_ONCE]
                yield hits_batch(block.idx[r], tile.idx[c], distance[r, c], [("shard", block.idx[r] // shard_size, pa.int64())])

        return near

    for part in query_tiles(queries, index.pivots, max_tile_bytes):
        shared = broadcast_vectors(part)
        idx, raw = shared.value
        if not len(idx):
            continue
        angle = _angles(raw, index.pivots)
        order = np.argsort(angle, axis=1, kind="stable")
        before = np.cumsum(index.n_rows[order], axis=1) - index.n_rows[order]
        first = np.zeros(angle.shape, bool)
        np.put_along_axis(first, order, before < NEAR_ROWS * k * n_shards, axis=1)
        first &= index.n_rows > 0
        found = through_table(_visited_rows(index, shared, first, kernel(None), NEAREST_SCHEMA), "near-cells")
        bounds = _bounds(found, shards, n_shards, k, idx)
        farthest = np.where(np.isfinite(bounds), np.arccos(np.clip(1.0 - np.where(np.isfinite(bounds), bounds, 0) - 0.5 * 10.0**-digits, -1, 1)), np.inf)
        then = ~first & (index.n_rows > 0) & (angle - index.radius <= farthest[:, None] + ANGLE_MARGIN)
        found.write.mode("append").parquet(path)
        _visited_rows(index, shared, then, kernel(bounds), NEAREST_SCHEMA).write.mode("append").parquet(path)
        counts = zip(idx.tolist(), first.sum(1).tolist(), then.sum(1).tolist(), [int((index.n_rows > 0).sum())] * len(idx))
        spark.createDataFrame(list(counts), VISITS_SCHEMA).write.mode("append").parquet(visits)
        shared.unpersist()
    return spark.read.schema(NEAREST_SCHEMA).parquet(path), spark.read.schema(VISITS_SCHEMA).parquet(visits)


def _bounds(found: DataFrame, shards: DataFrame, n_shards: int, k: int, idx: np.ndarray) -> np.ndarray:
    """For every query of a tile the largest k-th distance over all shards; infinite where a shard has fewer rows than it needs."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_idx", "shard").orderBy("distance", "centroid_idx")))
    last = ranked.join(shards, "shard").where("rank = needed").groupBy("query_idx").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
    known = {r["query_idx"]: r["d"] for r in last.where(F.col("n") == n_shards).collect()}  # one row a query of the tile
    return np.array([known.get(q, np.inf) for q in idx.tolist()])


@dataclass
class CellIndex:
    """A stored corpus laid out by cell: ``vectors`` (centroid_idx, embedding, angle, cell) and one
    pivot, radius and number of rows per cell."""

    vectors: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    n_rows: np.ndarray


CELL_SCHEMA = "cell int, pivot array<float>, radius double, n_rows long"


def build_cell_index(corpus: DataFrame, path: str, pivots: int = 256, seed: int = 0, mode: str = "errorifexists") -> None:
    """Store ``corpus`` with one folder per cell, for searches that read only the cells they visit."""
    if not _write_cells(corpus, path, pivots, seed, mode):
        raise ValueError("the corpus has no vectors")


def _write_cells(corpus: DataFrame, path: str, pivots: int, seed: int, mode: str) -> bool:
    spark = corpus.sparkSession
    chosen = choose_pivots(corpus, pivots, seed)
    if len(chosen) == 0:
        return False
    assign_cells(corpus, chosen).hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")
    sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n_rows"))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(chosen)]
    cells = spark.createDataFrame(rows, "cell int, pivot array<float>").join(sizes, "cell", "left")
    described = cells.select("cell", "pivot", F.coalesce("radius", F.lit(-1.0)).alias("radius"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    described.coalesce(1).write.mode(mode).parquet(f"{path}/cells")
    return True


def load_cell_index(spark: SparkSession, path: str) -> CellIndex:
    rows = spark.read.schema(CELL_SCHEMA).parquet(f"{path}/cells").orderBy("cell").collect()  # one row per pivot
    return CellIndex(
        spark.read.parquet(f"{path}/vectors"),
        np.array([r.pivot for r in rows], dtype=np.float32),
        np.array([r.radius for r in rows]),
        np.array([r.n_rows for r in rows], dtype=np.int64),
    )


def ann_join(
    queries: DataFrame,
    corpus: DataFrame | CellIndex,
    cutoff: float = COSINE_CUTOFF,
    pivots: int = 64,
    probes: int | None = 16,
    seed: int = 0,
    digits: int = DISTANCE_DIGITS,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Approximate threshold join: only the ``probes`` nearest cells of each query are visited.

    ``corpus`` is a table, whose vectors are put into cells while they are read, or a stored
    ``CellIndex``, of which only visited cells are read. Reported distances are exact, so the
    result is a subset of ``similarity_join``; recall grows with ``probes``. On an index,
    ``probes=None`` visits every cell that can hold a hit, and the result is complete.
    """
    queries = queries.select("query_idx", "embedding").where("embedding is not null")
    stored = corpus if isinstance(corpus, CellIndex) else None
    if probes is None and stored is None:
        raise ValueError("probes may only be left out on a stored index")
    n_queries, n_bytes = vector_bytes(queries)
    n_pivots = len(stored.pivots) if stored else pivots
    if n_bytes + n_queries * n_pivots * CHOICE_BYTES > max_broadcast_bytes:
        return cell_join(queries, corpus, cutoff, digits, pivots=pivots, probes=probes, seed=seed)

    spark = queries.sparkSession
    chosen = stored.pivots if stored else choose_pivots(corpus, pivots, seed)
    shared_queries = broadcast_vectors(queries)
    idx, raw = shared_queries.value
    if len(chosen) == 0 or len(idx) == 0:
        return _none(spark, hits_schema(False))
    max_angle = largest_angle(cutoff, digits)
    wanted = _wanted_cells(raw, chosen, stored.radius if stored else None, max_angle, probes)
    if not stored:
        stored = CellIndex(assign_cells(corpus, chosen), chosen, np.zeros(len(chosen)), np.ones(len(chosen), np.int64))

    def kernel(block, tile, _):
        return hit_batches(block, tile, cutoff, digits, False)

    return _visited_rows(stored, shared_queries, wanted, kernel, hits_schema(False))
