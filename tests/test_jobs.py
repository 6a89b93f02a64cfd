import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from kinspark import session
from kinspark.operators import hits
from kinspark.operators.embed import embed, hashed_kmer_encoder
from kinspark.plans import build
from kinspark.plans.search import Database, search
from kinspark.session import through_table
from kinspark.sources import fasta, stores, tables, texts
from kinspark.streaming.incremental import embed_stream

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
LOAD = hashed_kmer_encoder(64)


@pytest.fixture(scope="module")
def world(spark):
    """Five families; each has a representative, three members and, for the first two, a query."""
    rng = random.Random(2)
    families = ["".join(rng.choice(LETTERS) for _ in range(150)) for _ in range(5)]

    def vary(text, n):
        out = list(text)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice(LETTERS)
        return "".join(out)

    seqs = [(i, f"ERR{i}_7_1 family", f) for i, f in enumerate(families)]
    members = [
        (f"ERR{i}_7_1", f"ERR{i}_7_1_SRR{i}{m}_2_1 # {m} # 99 # -1", vary(f, 5)) for i, f in enumerate(families) for m in range(3)
    ]
    queries = [(0, "alpha", vary(families[0], 4)), (1, None, vary(families[1], 4))]
    sequences = spark.createDataFrame(seqs, "centroid_idx long, name string, sequence string")
    db = Database(
        sequences,
        embed(sequences, LOAD).select("centroid_idx", "embedding"),
        spark.createDataFrame(members, "centroid_id string, member_header string, sequence string"),
    )
    return db, spark.createDataFrame(queries, "query_idx long, query_name string, sequence string")


def test_search(spark, world, tmp_path):
    db, queries = world
    found = search(queries, db, cutoff=0.3, load=LOAD, align_options={"k": 4, "min_shared": 3})
    named = found.diversified_hits.collect()
    assert {(r.query_name, r.centroid_name) for r in named} >= {("alpha", "ERR0_7_1 family"), ("query_1", "ERR1_7_1 family")}
    assert [(r.query_name, r.distance) for r in named] == sorted((r.query_name, r.distance) for r in named)
    targets = {r.target for r in found.alignments.collect()}
    assert targets == {f"SRR{i}{m}_2_1#{m}#99#-1" for i in (0, 1) for m in range(3)}
    assert found.top_hits.count() == found.matches.count() == 6
    found.write(str(tmp_path / "out"))
    assert tables.read_alignments(spark, str(tmp_path / "out" / "alignments")).count() == found.alignments.count()
    heads = {r.name for r in fasta.read_fasta(spark, str(tmp_path / "out" / "proteins")).collect()}
    assert "SRR00_2_1#0#99#-1#ERR0_7_1" in heads
    counts = {r.stage: r.n_rows for r in found.counts().collect()}
    assert counts["queries"] == 2 and counts["alignments"] == found.alignments.count()


def test_texts_of_hits_are_put_in_after_the_sort(spark, world):
    db, queries = world
    found = search(queries, db, cutoff=2.1, load=LOAD)
    plan = plan_of(found.diversified_hits)
    assert "rangepartitioning" in plan and "sequence" not in plan[plan.index("rangepartitioning") :]
    want = {r.centroid_name: r.sequence for r in found.unique_centroids.collect()}
    named = found.diversified_hits.collect()
    assert len(named) > len(want) and all(r.sequence == want[r.centroid_name] for r in named)


def test_placed_texts_come_back_in_the_order_of_the_rows(spark):
    column = ["a", "", None, "\U0001d11e" * 50, "long " * 30_000, "\0 b"] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(column)], "i long, t string").repartition(3)
    placed = texts.place_texts(df, "t")
    assert set(placed.rows.columns) == {"i", *texts.PLACE}
    twice = placed.rows.unionByName(placed.rows).orderBy(F.desc("i"))
    assert [tuple(r) for r in placed.restore(twice).collect()] == [(i, column[i]) for i in reversed(range(len(column))) for _ in range(2)]
    assert placed.restore(twice.where("i < 0")).isEmpty()


def test_matched_texts_are_placed_alike_for_few_and_many_ids(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "x" * i) for i in range(60)], "i long, t string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*range(0, 90, 3), 3, 6, None]], "i long")
    want = rows(df.where("i % 3 = 0").select("i", F.length("t")))
    few, many = (texts.place_matched(df, ids, "i", "t", limit) for limit in (1 << 20, 0))
    for placed in (few, many):
        assert rows(placed.restore(placed.rows).select("i", F.length("t"))) == want


def test_a_search_writes_matched_texts_once(spark, world, monkeypatch):
    """Packed, and in none of its tables."""
    from kinspark.plans import search as job

    db, queries = world
    found = search(queries, db, cutoff=2.1, load=LOAD)
    written, write = {}, job.through_table

    def seen(df, name):
        written[name] = df.columns
        return write(df, name)

    for module in (job, texts):
        monkeypatch.setattr(module, "through_table", seen)
    assert found.diversified_hits.count() and found.unique_centroids.count()
    assert "hits" in written and not any("sequence" in columns for columns in written.values())


def test_representatives_shuffle_no_texts(spark, sf_dir):
    from kinspark.plans import views

    docs = views.table(spark, sf_dir, "documents")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    repeated = views.repeated_texts(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [views.representatives(spark, sf_dir, repeated=r) for r in (None, repeated, (repeated[0], False))]
        assert "hashpartitioning" not in plan_of(found[0]) + plan_of(found[1])
        for df in found:
            assert rows(df.select("centroid_idx")) == rows(first.select("doc_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_differences_are_those_of_except_all(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", None), ("c", 2.0)], "k string, v double")
    right = spark.createDataFrame([("a", 1.0), ("b", None), ("d", None), ("d", None)], "k string, v double")
    extra, missing = hits.differences(left, right)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(extra) == key(left.exceptAll(right)) and extra.count() == 3
    assert key(missing) == key(right.exceptAll(left)) and missing.count() == 2


def test_deep_search_contains_normal_search(spark, world):
    db, queries = world
    options = {"cutoff": 0.9, "load": LOAD, "align_options": {"k": 4, "min_shared": 3}}
    normal, deep = search(queries, db, **options), search(queries, db, deep=True, **options)
    assert set(rows(normal.proteins)) < set(rows(deep.proteins))
    assert rows(normal.diversified_hits) == rows(deep.diversified_hits)
    near = search(queries, db, approximate=True, ann_options={"pivots": 4, "probes": 4}, **options)
    assert rows(near.diversified_hits) == rows(normal.diversified_hits)


def test_search_without_hits_gives_empty_tables(spark, world):
    db, queries = world
    found = search(queries, db, cutoff=-1.0, load=LOAD)
    for name in ("diversified_hits", "kept_hits", "proteins", "alignments", "matches", "top_hits"):
        assert getattr(found, name).isEmpty(), name
    assert found.alignments.columns == list(tables.ALIGNMENT_COLUMNS)


def test_stored_query_vectors_are_reused(spark, world, tmp_path):
    db, queries = world
    path = str(tmp_path / "q")
    first = search(queries, db, cutoff=0.3, load=LOAD, query_embeddings=path)

    def broken():
        raise AssertionError("embedded again")

    second = search(queries, db, cutoff=0.3, load=broken, query_embeddings=path)
    assert rows(first.diversified_hits) == rows(second.diversified_hits)


def test_a_search_by_stored_vectors_sorts_no_texts(spark, world, tmp_path):
    db, queries = world
    found = search(queries, db, cutoff=2.1, load=LOAD, query_embeddings=str(tmp_path / "q"), reduce_queries=False)
    again = search(queries, db, cutoff=2.1, load=LOAD, query_embeddings=str(tmp_path / "q"), reduce_queries=False)
    plan = plan_of(again.diversified_hits)
    assert "rangepartitioning" in plan and "sequence" not in plan[plan.index("rangepartitioning") :]
    assert rows(again.diversified_hits) == rows(found.diversified_hits)


def test_nucleotide_queries_are_refused(spark, world):
    db, _ = world
    bad = spark.createDataFrame([(0, "x", "ACGTACGT")], "query_idx long, query_name string, sequence string")
    with pytest.raises(ValueError, match="nucleotide"):
        search(bad, db, load=LOAD)


def test_embedding_is_unit_and_ignores_trailing_stops(spark):
    df = spark.createDataFrame([(0, "MKVLL"), (1, "MKVLL**"), (2, "")], "centroid_idx long, sequence string")
    got = {r.centroid_idx: r.embedding for r in embed(df, hashed_kmer_encoder(8)).collect()}
    assert got[0] == got[1] and sum(x * x for x in got[0]) == pytest.approx(1.0, abs=1e-6)
    assert len(got[2]) == 8


def test_stream_embeds_every_file_once(spark, tmp_path):
    source, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    source.mkdir()
    (source / "a.fa").write_text(">a\nMKV\nLL\n>b\nMMK\n")
    embed_stream(spark, str(source), store, checkpoint, LOAD).awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(store).collect()) == ["a", "b"]
    (source / "b.fa").write_text(">c\nWWW\n")
    for _ in range(2):
        embed_stream(spark, str(source), store, checkpoint, LOAD).awaitTermination()
    got = spark.read.parquet(store)
    assert sorted((r.name, r.file_name) for r in got.collect()) == [("a", "a.fa"), ("b", "a.fa"), ("c", "b.fa")]
    assert got.where(F.size("embedding") != 64).isEmpty()
    assert sorted((r.centroid_idx, r.name) for r in got.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    hit = search(
        spark.createDataFrame([(0, "q", "WWWWW")], "query_idx long, query_name string, sequence string"),
        Database(got.select("centroid_idx", "name", "sequence"), got.select("centroid_idx", "embedding"), got.limit(0)),
        cutoff=0.9, load=LOAD, reduce_queries=False,
    ).diversified_hits.collect()
    assert hit[0].centroid_name == "c"  # the nearest comes first


def test_an_interrupted_build_keeps_finished_chunks(spark, tmp_path):
    table = spark.createDataFrame([(i, f"MKV{'L' * i}W") for i in range(40)] + [(40, None)], "centroid_idx long, sequence string")
    path, calls = str(tmp_path / "store"), str(tmp_path / "calls")

    def counting(fail_at=None):
        def load():
            encode = LOAD()

            def run(texts):
                for t in texts:
                    length = len(t) - len("<+>MKVW")
                    if length == fail_at:
                        raise RuntimeError("encoder stopped")
                    with open(calls, "a") as log:
                        log.write(f"{length}\n")
                return encode(texts)

            return run

        return load

    with pytest.raises(Exception, match="encoder stopped"):
        build.build_index(table, counting(fail_at=25), path, chunk_size=10, batch_size=1, commit_chunks=1)
    assert sorted(r.centroid_idx for r in spark.read.parquet(path).collect()) == list(range(20))
    open(calls, "w").close()
    store = build.build_index(table, counting(), path, chunk_size=10, batch_size=1, commit_chunks=1, resume=True)
    assert sorted(r.centroid_idx for r in store.collect()) == list(range(40))
    assert sorted(map(int, open(calls))) == list(range(20, 40))
    open(calls, "w").close()
    build.build_index(table, counting(), path, chunk_size=10, resume=True)
    assert open(calls).read() == ""


def test_a_chunk_that_is_stored_in_part_is_completed(spark, tmp_path):
    table = spark.createDataFrame([(i, "MKVLL" * (i + 1)) for i in range(30)], "centroid_idx long, sequence string")
    path = str(tmp_path / "store")
    build.build_index(table.where("centroid_idx % 3 = 0"), LOAD, path, chunk_size=10)
    store = build.build_index(table, LOAD, path, chunk_size=10, resume=True)
    assert sorted(r.centroid_idx for r in store.collect()) == list(range(30))


def test_vectors_of_other_queries_are_refused(spark, world, tmp_path):
    db, queries = world
    path = str(tmp_path / "q")
    search(queries, db, load=LOAD, query_embeddings=path, reduce_queries=False).hits
    others = queries.withColumn("sequence", F.concat("sequence", F.lit("W")))
    with pytest.raises(ValueError, match="other queries"):
        search(others, db, load=LOAD, query_embeddings=path)


def test_stored_sequences_are_read_by_range(spark, tmp_path):
    table = spark.createDataFrame([(i, f">n{i} x", "MKV" * (i + 1)) for i in range(50)], "centroid_idx long, name string, sequence string")
    path = str(tmp_path / "sequences")
    stores.write_sequences(table, path, chunk_size=10)
    found = spark.createDataFrame([(3, 0, 0.1), (41, 0, 0.2), (99, 0, 0.1)], "centroid_idx long, query_idx long, distance double")
    named = hits.attach_sequences(found, stores.read_sequences(spark, path))
    assert rows(named) == rows(hits.attach_sequences(found, table))
    pruned = stores.matched_chunks(stores.read_sequences(spark, path), found)
    assert "chunk" in plan_of(pruned).split("PartitionFilters: [")[1].split("]")[0] and pruned.count() == 20


def test_scratch_is_removed_at_the_end(spark):
    kept = spark.sparkContext.applicationId
    table = through_table(spark.range(3), "scratch-test")
    assert kept in table.inputFiles()[0] and table.count() == 3
    assert session.clean_scratch(spark) and not session.clean_scratch(spark)


def test_documents_stay_where_they_are_read_when_many_are_repeated(spark, sf_dir):
    from kinspark.plans import views

    ids, _ = views.repeated_texts(spark, sf_dir)
    assert ids.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = (views.representatives(spark, sf_dir, spread, (ids, small)) for spread, small in ((True, True), (True, False)))
        assert "hashpartitioning" not in plan_of(views.representatives(spark, sf_dir, repeated=(ids, False)))
        assert rows(few) == rows(many)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_rows_are_left_out_by_their_places_in_files(spark, tmp_path, limit):
    """Files of several bitmaps and row groups, read in splits; keys that are null, or in several rows."""
    from kinspark.plans import views

    key = F.when(F.col("id") % 1_000 == 7, None).when(F.col("id") % 50_000 == 3, 3).otherwise(F.col("id"))
    whole = spark.range(150_000).select(key.alias("k"), F.col("id").cast("string").alias("text"))
    whole.repartitionByRange(2, "text").write.option("parquet.block.size", 64 * 1024).parquet(str(tmp_path / "t"))
    ids = spark.range(200_000).where("id % 3 = 0 or id between 70000 and 90000").withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        left = views.without_ids(spark.read.parquet(str(tmp_path / "t")), ids, "k", limit)
        want = whole.where("k is not null").join(ids, "k", "left_anti")
        assert left.columns == ["k", "text"] and left.count() == want.count() > 50_000
        assert left.exceptAll(want).isEmpty() and want.exceptAll(left).isEmpty()
        assert views.without_ids(spark.read.parquet(str(tmp_path / "t")), ids.limit(0), "k", limit).count() == whole.where("k is not null").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_search_with_stored_query_vectors_shuffles_no_texts_when_many_are_repeated(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry
    from kinspark.plans import views

    want = rows(entry.queries()["f05_reuse_query_embeddings"](spark, sf_dir))
    plans, write, measured = {}, session.through_table, views.measured_ids

    def seen(df, name):
        plans[name] = plan_of(df)
        return write(df, name)

    monkeypatch.setattr(views, "measured_ids", lambda ids, key: (measured(ids, key)[0], False))
    for module in (entry, texts):
        monkeypatch.setattr(module, "through_table", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(entry.queries()["f05_reuse_query_embeddings"](spark, sf_dir)) == want != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("text" in plans[name] and "hashpartitioning" not in plans[name] for name in ("representative-vectors", "text-places"))
