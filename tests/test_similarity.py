import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from kinspark.functions import vectors
from kinspark.operators import blocks, cells, hits, similarity
from kinspark.plans import views


def sides(spark, sf_dir):
    corpus = views.corpus_vectors(spark, sf_dir)
    return corpus.select(F.col("centroid_idx").alias("query_idx"), "embedding"), corpus


def from_numpy(spark, key, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} long, embedding array<float>")


# Counts of pairs of the first twenty vectors, worked out in SQL beforehand.
@pytest.mark.parametrize("cutoff,count", [(0.2, 20), (0.75, 244), (0.8, 571)])
def test_known_counts(spark, sf_dir, cutoff, count):
    queries, corpus = sides(spark, sf_dir)
    assert similarity.similarity_join(queries.where("query_idx < 20"), corpus, cutoff).count() == count


def test_scan_cells_and_expression_agree(spark, sf_dir):
    queries, corpus = sides(spark, sf_dir)
    scanned = similarity.similarity_join(queries, corpus, 0.75, with_squared_l2=True)
    cellwise = similarity.similarity_join(queries, corpus, 0.75, with_squared_l2=True, max_broadcast_bytes=1)
    q = queries.select("query_idx", F.col("embedding").alias("q"))
    distance = vectors.rounded(vectors.cosine_distance("embedding", "q"))
    plain = corpus.join(q, similarity.below_cutoff(distance, 0.75)).select(
        "centroid_idx", "query_idx", distance.alias("distance"), vectors.rounded(vectors.squared_l2("embedding", "q"))
    )
    assert rows(scanned) == rows(cellwise) == rows(plain)


def test_scan_has_no_shuffle_and_reads_two_columns(spark, sf_dir):
    queries, corpus = sides(spark, sf_dir)
    plan = plan_of(similarity.similarity_join(queries, corpus))
    assert "Exchange" not in plan and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_cells_split_a_cell_that_holds_most_rows(spark):
    rng = np.random.default_rng(1)
    one = rng.normal(size=8)
    m = np.vstack([np.repeat([one], 300, axis=0), rng.normal(size=(100, 8))])
    corpus, queries = from_numpy(spark, "centroid_idx", m), from_numpy(spark, "query_idx", m[::40])
    whole = similarity.similarity_join(queries, corpus, 0.2)
    split = cells.cell_join(queries, corpus, 0.2, pivots=8, max_tile_bytes=400)
    assert rows(whole) == rows(split)
    assert whole.where("query_idx = 0").count() >= 300


def test_the_cell_join_writes_vectors_but_no_hits(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = np.repeat(rng.normal(size=(12, 8)), 20, axis=0)
    corpus, queries = from_numpy(spark, "centroid_idx", m), from_numpy(spark, "query_idx", m)
    written, fresh = [], cells.scratch_path
    monkeypatch.setattr(cells, "scratch_path", lambda s, name: written.append(name) or fresh(s, name))
    split = cells.cell_join(queries, corpus, 0.2, pivots=8, max_tile_bytes=20_000)
    assert split.count() >= 12 * 20 * 20 and set(written) == {"cells", "query-tiles"}
    assert rows(split) == rows(similarity.similarity_join(queries, corpus, 0.2))


def test_a_table_of_pairs_takes_half_of_what_it_took_in_order_of_keys(spark, tmp_path):
    m = np.random.default_rng(6).normal(size=(4_000, 32))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    corpus, queries = from_numpy(spark, "centroid_idx", m), from_numpy(spark, "query_idx", m)
    for tile_bytes in (20_000_000, 1_000_000):
        pairs = cells.cell_join(queries, corpus, 0.75, with_squared_l2=True, pivots=1, max_tile_bytes=tile_bytes)
        pairs.write.parquet(str(tmp_path / f"by-distance-{tile_bytes}"))
        keyed = spark.read.parquet(str(tmp_path / f"by-distance-{tile_bytes}")).repartition(1).sortWithinPartitions("centroid_idx", "query_idx")
        keyed.write.parquet(str(tmp_path / f"by-keys-{tile_bytes}"))
        ours, theirs = (sum(f.stat().st_size for f in (tmp_path / f"{name}-{tile_bytes}").glob("*.parquet")) for name in ("by-distance", "by-keys"))
        assert keyed.count() > 500_000 and ours < 0.6 * theirs


@pytest.mark.parametrize("squared", [False, True])
def test_pairs_are_ordered_a_stretch_at_a_time_and_all_there(squared):
    rng = np.random.default_rng(7)
    extra = lambda d: [("squared_l2", 2 * d[::-1], pa.float64())] if squared else []
    distances = [np.round(rng.random(n), 2) for n in (0, 1, 250, 99, 1)]
    given = [blocks.hits_batch(np.arange(len(d)), np.arange(len(d)) + 1000 * i, d, extra(d)) for i, d in enumerate(distances)]
    for rows_at_once in (1, 100, 351, 1000):
        found = pa.Table.from_batches(blocks.by_distance(iter(given), rows_at_once), given[0].schema)
        keys = [(name, "ascending") for name in found.column_names]
        assert found.sort_by(keys).equals(pa.Table.from_batches(given).sort_by(keys))
        for i in range(0, found.num_rows, rows_at_once):
            assert (np.diff(found.column("distance").to_numpy()[i : i + rows_at_once]) >= 0).all()
    assert list(blocks.by_distance(iter(given[:1]))) == []


def test_zero_vectors_and_empty_sides(spark):
    corpus = from_numpy(spark, "centroid_idx", np.array([[0.0, 0.0], [1.0, 0.0]]))
    queries = from_numpy(spark, "query_idx", np.array([[1.0, 0.0]]))
    assert rows(similarity.similarity_join(queries, corpus, 0.5)) == [(1, 0, 0.0)]
    none = queries.where("query_idx < 0")
    assert similarity.similarity_join(none, corpus).isEmpty()
    assert cells.cell_join(queries, corpus.where("centroid_idx < 0")).isEmpty()
    assert cells.cell_join(none, corpus).isEmpty()


def test_dimension_mismatch_is_an_error(spark):
    corpus = from_numpy(spark, "centroid_idx", np.eye(3))
    with pytest.raises(Exception, match="dimension"):
        similarity.similarity_join(from_numpy(spark, "query_idx", np.eye(2)), corpus).collect()


def brute_nearest(m, q, k, shard):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - unit(m) @ unit(q).T, 6) + 0.0
    out = []
    for j in range(q.shape[0]):
        for s in range(0, len(m), shard):
            best = sorted((d[i, j], i) for i in range(s, min(s + shard, len(m))))[:k]
            out += [(j, s // shard, i, dist, r + 1) for r, (dist, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("limit", [similarity.MAX_BROADCAST_BYTES, 1])
def test_nearest_with_ties(spark, limit):
    rng = np.random.default_rng(2)
    m = rng.integers(-1, 2, size=(90, 3)).astype(float) + [0, 0, 0.5]
    q = m[:4]
    got = similarity.nearest(
        from_numpy(spark, "query_idx", q), from_numpy(spark, "centroid_idx", m).repartition(3), 5, 30, max_broadcast_bytes=limit
    )
    assert rows(got) == brute_nearest(m, q, 5, 30)


def test_deepening_matches_threshold_join(spark, sf_dir):
    queries, corpus = sides(spark, sf_dir)
    queries = queries.where("query_idx < 20")
    found = similarity.similarity_join(queries, corpus, 0.75)
    report = similarity.deepening_report(found, 100, start=20)
    assert report.where("not complete").isEmpty()
    k = report.agg(F.max("k")).first()[0]
    near = similarity.nearest(queries, corpus, k, 100)
    assert similarity.coverage(near, k, 0.75).where("saturated").isEmpty()
    deep = near.where(similarity.below_cutoff("distance", 0.75)).select("centroid_idx", "query_idx", "distance")
    assert rows(deep) == rows(found)


def near_copies(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(600, 32))
    q = m[::10] + 0.25 * rng.normal(size=(60, 32))
    return from_numpy(spark, "query_idx", q), from_numpy(spark, "centroid_idx", m)


@pytest.mark.parametrize("limit", [similarity.MAX_BROADCAST_BYTES, 1])
def test_approximate_join_is_an_exact_subset(spark, limit):
    queries, corpus = near_copies(spark)
    exact = set(rows(similarity.similarity_join(queries, corpus)))
    near = set(rows(cells.ann_join(queries, corpus, max_broadcast_bytes=limit)))
    assert near <= exact and len(near) >= 0.95 * len(exact) and len(exact) >= 55
    full = cells.ann_join(queries, corpus, pivots=16, probes=16, max_broadcast_bytes=limit)
    assert set(rows(full)) == exact


@pytest.mark.parametrize("limit", [similarity.MAX_BROADCAST_BYTES, 1])
def test_stored_cells_are_pruned_and_complete(spark, tmp_path, limit):
    queries, corpus = near_copies(spark)
    exact = set(rows(similarity.similarity_join(queries, corpus)))
    cells.build_cell_index(corpus, str(tmp_path / "index"), pivots=32)
    index = cells.load_cell_index(spark, str(tmp_path / "index"))
    assert index.n_rows.sum() == 600
    assert set(rows(cells.ann_join(queries, index, probes=None, max_broadcast_bytes=limit))) == exact
    few = cells.ann_join(queries.where("query_idx < 2"), index, probes=2)
    assert "Exchange" not in plan_of(few) and "cell" in plan_of(few).split("PartitionFilters: [")[1].split("]")[0]
    assert set(rows(few)) <= exact


@pytest.mark.parametrize("dim", [8, 64, 512])
def test_hits_just_inside_the_cutoff_near_a_pivot(spark, dim):
    """A copy very near its pivot, and queries just inside the cutoff on the pivot's far side."""
    rng = np.random.default_rng(dim)
    unit = lambda x: x / np.linalg.norm(x)
    pivot = unit(rng.normal(size=dim))
    corpus, queries = [pivot], []
    for apart in (1e-4, 2e-4, 6e-4, 2e-3):
        side = rng.normal(size=dim)
        side = unit(side - side @ pivot * pivot)
        corpus.append(np.cos(apart) * pivot + np.sin(apart) * side)
        inside = np.arccos(1 - 0.199994) - apart
        queries.append(np.cos(inside) * pivot - np.sin(inside) * side)
    q, c = from_numpy(spark, "query_idx", queries), from_numpy(spark, "centroid_idx", corpus)
    scanned = rows(similarity.similarity_join(q, c, 0.2))
    assert scanned and rows(cells.cell_join(q, c, 0.2, pivots=1)) == scanned
    assert rows(similarity.similarity_join(q, c, 0.2, max_broadcast_bytes=1)) == scanned


@pytest.mark.parametrize("probes", [1, 2, 4])
def test_approximate_join_is_the_same_at_every_size(spark, tmp_path, probes):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    m = centres[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))
    q, c = from_numpy(spark, "query_idx", m[:60]), from_numpy(spark, "centroid_idx", m)
    small, large = (cells.ann_join(q, c, pivots=32, probes=probes, max_broadcast_bytes=b) for b in (similarity.MAX_BROADCAST_BYTES, 1))
    cells.build_cell_index(c, str(tmp_path / "cells"), pivots=32)
    stored = cells.ann_join(q, cells.load_cell_index(spark, str(tmp_path / "cells")), probes=probes)
    assert rows(small) == rows(large) == rows(stored)


@pytest.mark.parametrize("tile_bytes", [1 << 26, 3000])
def test_bounded_nearest_equals_a_scan_and_visits_few_cells(spark, tile_bytes):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    m = centres[rng.integers(0, 20, 1500)] + 0.05 * rng.normal(size=(1500, 16))
    m[100:110] = m[100]  # ties
    q, c = from_numpy(spark, "query_idx", m[95:125]), from_numpy(spark, "centroid_idx", m)
    # Shards of 750, 750; then an index of which only few cells are within the bounds.
    scanned = rows(similarity.nearest(q, c, 5, 750))
    assert rows(similarity.nearest(q, c, 5, 750, max_broadcast_bytes=1)) == scanned
    _, visits = cells.cell_nearest(q, c, 5, 750, 6, pivots=64, max_tile_bytes=tile_bytes)
    seen = visits.collect()
    assert sorted(v["query_idx"] for v in seen) == list(range(30))
    assert sum(v["near_cells"] + v["further_cells"] for v in seen) < 0.5 * sum(v["all_cells"] for v in seen)


def test_nearest_of_shards_with_fewer_rows_than_wanted(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(103, 8))
    q, c = from_numpy(spark, "query_idx", m[:4]), from_numpy(spark, "centroid_idx", m)
    for k in (1, 7, 200):
        assert rows(similarity.nearest(q, c, k, 25, max_broadcast_bytes=1)) == rows(similarity.nearest(q, c, k, 25))
    none = c.where("centroid_idx < 0")
    assert similarity.nearest(q, none, 3, 25, max_broadcast_bytes=1).isEmpty()
    assert cells.cell_nearest(none.withColumnRenamed("centroid_idx", "query_idx"), c, 3, 25, 6)[0].isEmpty()


def test_a_crowd_of_near_copies_is_multiplied_in_blocks():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 32))
    m = np.vstack([base[0] + 0.01 * rng.normal(size=(300, 32)), rng.normal(size=(200, 32)), base[1:]]).astype(np.float32)
    q = np.vstack([base[0] + 0.01 * rng.normal(size=(150, 32)), base[1:]]).astype(np.float32)
    corpus, queries = blocks.VectorBlock(np.arange(len(m)), m), blocks.VectorBlock(np.arange(len(q)), q)
    found = sorted((int(r), int(c), float(d)) for rs, cs, ds in blocks.pairs_below(corpus, queries, 0.2, 6) for r, c, d in zip(rs, cs, ds))
    distance = blocks.round_distance(1 - blocks.unit_rows(m) @ blocks.unit_rows(q).T, 6)
    assert found == sorted((int(r), int(c), float(distance[r, c])) for r, c in zip(*np.nonzero(distance < 0.2))) and len(found) > 40_000


def test_an_index_is_searched_exactly(spark, tmp_path, sf_dir):
    queries, corpus = sides(spark, sf_dir)
    cells.build_cell_index(corpus, str(tmp_path / "cells"), pivots=32)
    index = cells.load_cell_index(spark, str(tmp_path / "cells"))
    assert rows(similarity.similarity_join(queries, index, 0.7)) == rows(similarity.similarity_join(queries, corpus, 0.7))


def test_too_many_pivots_are_refused(spark):
    c = from_numpy(spark, "centroid_idx", np.eye(3))
    with pytest.raises(ValueError, match="pivots"):
        cells.choose_pivots(c, cells.MAX_PIVOTS + 1)


def test_a_chain_of_stages_runs_each_step_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    first = spark.range(500).mapInArrow(seen, "id long")
    steps = [("all", lambda **_: first), ("even", lambda all: all.where("id % 2 = 0")), ("none", lambda all, even: even.where("id < 0")), ("twice", lambda all, even, none: even.union(even))]
    tables, counts = hits.staged(spark, steps)
    assert {r["stage"]: r["n_rows"] for r in counts.collect()} == {"all": 500, "even": 250, "none": 0, "twice": 500}
    assert tables["twice"].count() == 500 and ran.value == 500


def test_reports(spark):
    h = spark.createDataFrame([(5, 1, 0.1), (5, 0, 0.2), (105, 0, 0.1)], "centroid_idx long, query_idx long, distance double")
    assert rows(hits.matches_per_shard(h, 100)) == [(0, 1), (1, 1)]
    assert [tuple(map(tuple, r.matches)) for r in hits.hits_by_centroid(h).orderBy("centroid_idx").collect()] == [
        ((0, 0.2), (1, 0.1)), ((0, 0.1),)
    ]
    assert rows(hits.stage_counts({"a": h, "b": h.limit(0)})) == [("a", 3), ("b", 0)]
