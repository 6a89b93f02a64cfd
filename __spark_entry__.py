"""Registered queries, each over whole tables, and their SQL counterparts."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from kinspark.functions import hashing, headers, ranges, validation, vectors  # noqa: E402
from kinspark.operators import align as al  # noqa: E402
from kinspark.operators import cells, cluster, hits, kmers, seeds, similarity, stats  # noqa: E402
from kinspark.operators import members as mem  # noqa: E402
from kinspark.operators.embed import embed, hashed_kmer_encoder  # noqa: E402
from kinspark.operators.skew import MAX_ID_BYTES  # noqa: E402
from kinspark.plans import build, views  # noqa: E402
from kinspark.plans import search as job  # noqa: E402
from kinspark.session import scratch_path, ship_package, through_table  # noqa: E402
from kinspark.sources import fasta, formats, stores, tables  # noqa: E402
from kinspark.sources import vectors as vec_io  # noqa: E402
from kinspark.streaming.incremental import embed_stream  # noqa: E402

try:
    import kinspark.llm.queries as text_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("kinspark.llm", "kinspark.llm.queries"):
        raise
    text_queries = None

CUTOFF = 0.75  # the vectors of the tables are far apart
SHARD = 100
DIM = 64
TEXT_CUTOFF = 0.3
ALIGN = {"k": 12, "min_shared": 5}


def entry(spark: SparkSession) -> DataFrame:
    """Named neighbours of every label's mean vector, by distance."""
    return queries()["o02_sort_named_hits"](spark, "/root/testdata/sf0.001")


# --- building blocks ------------------------------------------------------------------


def r6(value):
    return vectors.rounded(value)


def _hits(spark, d):
    return similarity.similarity_join(views.query_vectors(spark, d), views.corpus_vectors(spark, d), CUTOFF)


def _named(spark, d):
    return hits.name_hits(_hits(spark, d), views.sequences(spark, d), views.query_vectors(spark, d))


def _pairs_of_vectors(spark, d):
    """Every embedding next to the mean vector of its label."""
    e = views.table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("query_idx"), "embedding")
    q = views.query_vectors(spark, d).select("query_idx", F.col("embedding").alias("q"))
    return hits.salted_join(e, q, "query_idx", spread=F.col("vec_id"))


def _neighbours(spark, d, k):
    return similarity.nearest(views.query_vectors(spark, d), views.corpus_vectors(spark, d), k, SHARD)


def _written(spark, name, write, read):
    path = scratch_path(spark, name)
    write(path)
    return read(path)


def _seed_centroids(spark, d):
    """Ids of the representatives that share a seed with a query."""
    pairs = views.seed_pairs(spark, d)
    names = views.sequences(spark, d).select(F.col("centroid_idx").alias("target_idx"), "name")
    found = pairs.select("target_idx").distinct().join(names, "target_idx")
    return found.select(headers.record_id("name").alias("centroid_id")).distinct()


def _centroid_ids(spark, d):
    return views.membership(spark, d).select("centroid_id").distinct()


def _proteins(spark, d):
    return mem.protein_headers(mem.distinct_members(mem.expand_members(_centroid_ids(spark, d), views.members(spark, d))))


def _embedded(df):
    return _unpacked(embed(df, hashed_kmer_encoder(DIM)))


def _unpacked(df):
    values = df.select("centroid_idx", F.size("embedding").alias("dims"), F.posexplode("embedding").alias("dim", "value")).where("value <> 0")
    return values.select("centroid_idx", "dims", "dim", r6(F.col("value").cast("double")).alias("value"))


def _parsed(lines, texts, numbers):
    """Lines as written: the first fields as they are, the last ones as numbers (null in the header), as text forms of doubles differ between engines."""
    tail = F.substring_index("value", "\t", -len(numbers))
    field = lambda i: F.element_at(F.split(tail, "\t"), i + 1)
    parsed = [F.round(field(i).try_cast("double"), 6).alias(c) for i, c in enumerate(numbers)]
    header = F.when(F.col("value").startswith("#"), tail).alias("header")
    return lines.select(F.substring_index("value", "\t", texts).alias("line"), *parsed, header)


def _database(spark, d):
    repeated = views.repeated_texts(spark, d)
    reps = views.representatives(spark, d, spread=True, repeated=repeated)
    e = through_table(embed(reps, hashed_kmer_encoder(DIM)).select("centroid_idx", "embedding"), "representative-vectors")
    return job.Database(views.representatives(spark, d, repeated=repeated), e, views.members(spark, d))


def _search(spark, d, db=None, **options):
    return job.search(
        views.queries(spark, d), db or _database(spark, d), TEXT_CUTOFF, load=hashed_kmer_encoder(DIM),
        reduce_queries=False, align_options=ALIGN, **options,
    )


def _text_pairs(spark, d):
    targets = views.raw_proteins(spark, d, spread=True).select(headers.record_id("name").alias("target"), "sequence")
    probes = views.queries(spark, d).select(F.col("query_name").alias("query"), "sequence")
    return targets, probes


# --- sources and sinks ----------------------------------------------------------------


def s01(spark, d):
    df = views.sequences(spark, d)
    return _written(spark, "s01", lambda p: tables.write_fasta(df, "name", "sequence", p), lambda p: fasta.read_fasta(spark, p))


def s02(spark, d):
    df = views.sequences(spark, d).select(tables.fasta_record(F.col("name"), F.col("sequence")).alias("value"))
    return _written(spark, "s02", lambda p: df.write.option("compression", "gzip").text(p), lambda p: fasta.read_fasta(spark, p))


def s02_frames(spark, d):
    """Records in Zstandard frames, written and read by a data source."""
    formats.register_formats(spark)
    df = views.sequences(spark, d).select(tables.fasta_record(F.col("name"), F.col("sequence")).alias("value"))
    return _written(
        spark, "s02", lambda p: df.write.format("zstd_fasta").mode("append").save(p),
        lambda p: fasta.parse_records(spark.read.format("zstd_fasta").load(p)).select("name", "sequence"),
    )


def s04(spark, d):
    """Half-precision vectors, written and read by a data source; keys are places in the files."""
    formats.register_formats(spark)
    df = views.corpus_vectors(spark, d).repartitionByRange(4, "centroid_idx").sortWithinPartitions("centroid_idx")
    back = _written(
        spark, "s04", lambda p: df.select("centroid_idx", "embedding").write.format("half_vectors").option("dim", DIM).mode("append").save(p),
        lambda p: spark.read.format("half_vectors").option("dim", DIM).load(p),
    )
    return back.select("centroid_idx", F.posexplode("embedding").alias("dim", "value")).select("centroid_idx", "dim", F.col("value").cast("double").alias("value"))


def s03(spark, d):
    df = views.sequences(spark, d)
    return _written(
        spark, "s03", lambda p: tables.write_fasta(df, "name", "sequence", p), lambda p: fasta.read_fasta(spark, p, glob="part-*.txt")
    )


def s05(spark, d):
    df = views.membership(spark, d).select(F.concat_ws(" ", "centroid_id", "member_id").alias("value"))
    return _written(spark, "s05", lambda p: df.write.text(p), lambda p: tables.read_membership(spark, p))


def s06(spark, d):
    df = _named(spark, d)
    return _written(spark, "s06", lambda p: tables.write_diversified_hits(df, p), lambda p: tables.read_hits_tsv(spark, p))


def s07(spark, d):
    df = views.seed_alignments(spark, d)
    back = _written(spark, "s07", lambda p: tables.write_alignments(df, p), lambda p: tables.read_alignments(spark, p))
    return back.withColumn("evalue", r6("evalue"))


def s08(spark, d):
    df = views.query_vectors(spark, d).withColumn("query_name", F.lit(None).cast("string"))
    q = _written(spark, "s08", lambda p: vec_io.write_query_embeddings(df, p), lambda p: vec_io.load_query_embeddings(spark, p))
    return q.select("query_idx", "query_name", F.round(vectors.norm("embedding"), 5).alias("norm"))


def k01(spark, d):
    df = _named(spark, d)
    lines = _written(spark, "k01", lambda p: tables.write_diversified_hits(df, p), lambda p: spark.read.text(p))
    return _parsed(lines, 3, ["distance"])


def k02(spark, d):
    df = _named(spark, d)
    return _written(spark, "k02", lambda p: tables.write_hit_fasta(df, p), lambda p: fasta.read_fasta(spark, p))


def k03(spark, d):
    df = hits.distinct_centroid_sequences(_named(spark, d))
    return _written(
        spark, "k03", lambda p: tables.write_fasta(df, "centroid_name", "sequence", p), lambda p: fasta.read_fasta(spark, p)
    )


def k04(spark, d):
    df = views.members(spark, d)
    return _written(spark, "k04", lambda p: tables.write_member_fasta(df, p), lambda p: fasta.read_fasta(spark, p))


def k05(spark, d):
    df = j08(spark, d)
    return _written(
        spark, "k05", lambda p: tables.write_fasta(df, "protein_header", "sequence", p), lambda p: fasta.read_fasta(spark, p)
    )


def k06(spark, d):
    df = views.seed_alignments(spark, d)
    lines = _written(spark, "k06", lambda p: tables.write_alignments(df, p), lambda p: spark.read.text(p))
    return _parsed(lines, 10, ["evalue", "bitscore"])


def k07(spark, d):
    df = hits.top_hit_per_target(views.seed_alignments(spark, d))
    back = _written(spark, "k07", lambda p: tables.write_alignments(df, p), lambda p: tables.read_alignments(spark, p))
    return back.withColumn("evalue", r6("evalue"))


def k08(spark, d):
    df = views.raw_proteins(spark, d)
    back = _written(spark, "k08", lambda p: stores.write_sharded(df, p), lambda p: spark.read.parquet(p))
    return back.select("protein_id", "header", "sequence", (F.col("shard") == hashing.id_shard("protein_id")).alias("placed"))


def k09(spark, d):
    df = views.corpus_vectors(spark, d)
    back = _written(spark, "k09", lambda p: vec_io.write_embeddings(df, p, SHARD), lambda p: vec_io.read_embeddings(spark, p))
    return back.select("centroid_idx", F.col("chunk").cast("long").alias("chunk"), r6(vectors.norm("embedding")).alias("norm"))


def k10(spark, d):
    df = views.members(spark, d)
    back = _written(spark, "k10", lambda p: stores.write_member_store(df, p, 64), lambda p: stores.read_member_store(spark, p))
    return back.select("centroid_id", "member_header", "sequence", F.col("dir").cast("long").alias("dir"), F.col("grp").cast("long").alias("grp"))


def k11(spark, d):
    df = views.query_vectors(spark, d)
    back = _written(spark, "k11", lambda p: vec_io.write_query_embeddings(df, p), lambda p: spark.read.parquet(p))
    return back.select("query_idx", "query_name", r6(vectors.norm("embedding")).alias("norm"))


# --- expressions ----------------------------------------------------------------------


def p01(spark, d):
    pairs = _pairs_of_vectors(spark, d)
    scored = pairs.select("vec_id", "query_idx", r6(vectors.cosine_distance("embedding", "q")).alias("distance"))
    return scored.where(similarity.below_cutoff("distance", CUTOFF))


def p02(spark, d):
    words = views.table(spark, d, "documents").select(
        F.col("source").alias("name"), F.explode(F.split("text", " ")).alias("sequence")
    )
    return validation.validation_report(words)


def p03(spark, d):
    words = views.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return headers.drop_comments(words, "line").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def p04(spark, d):
    return views.sequences(spark, d).select("centroid_idx", headers.record_id("name").alias("record_id"))


def p05(spark, d):
    return views.raw_proteins(spark, d).select("name", headers.truncate_header("name").alias("header"))


def p06(spark, d):
    long_form = views.members(spark, d).select("member_header")
    # The other layout: representative and member separated by a space.
    spaced = F.regexp_replace("member_header", "_(M[0-9]+ )", " $1")
    both = long_form.unionByName(long_form.select(spaced.alias("member_header")))
    return both.select(
        "member_header",
        headers.member_accession("member_header").alias("accession"),
        headers.member_name("member_header").alias("member"),
    )


def p07(spark, d):
    return views.sequences(spark, d).select("centroid_idx", headers.composite_header("name", F.lit("query")).alias("header"))


def p08(spark, d):
    starred = F.concat("sequence", F.lit("**"))
    return views.sequences(spark, d).select("centroid_idx", headers.model_text(starred).alias("model_text"))


def p09(spark, d):
    return views.sequences(spark, d).select("centroid_idx", headers.strip_marker(F.concat(F.lit(">>"), "name")).alias("name"))


def p10(spark, d):
    scaled = F.transform("embedding", lambda x: x * F.lit(3.0))
    unit = views.corpus_vectors(spark, d).select("centroid_idx", vectors.normalise(scaled).alias("embedding"))
    return unit.select("centroid_idx", F.posexplode("embedding").alias("dim", "value")).select(
        "centroid_idx", "dim", r6("value").alias("value")
    )


def p11(spark, d):
    e = views.corpus_vectors(spark, d)
    return e.agg(
        F.bool_and(vectors.is_unit("embedding")).alias("all_unit"),
        F.count_if(~vectors.is_unit(F.transform("embedding", lambda x: x * 2))).alias("n_not_unit"),
    )


def p12(spark, d):
    return _pairs_of_vectors(spark, d).select("vec_id", "query_idx", r6(vectors.cosine_distance("embedding", "q")).alias("distance"))


def p13(spark, d):
    return _pairs_of_vectors(spark, d).select("vec_id", "query_idx", r6(vectors.squared_l2("embedding", "q")).alias("squared_l2"))


def p14(spark, d):
    pairs = _pairs_of_vectors(spark, d).withColumn("q", vectors.normalise("q"))
    distance = vectors.cosine_distance("embedding", "q")
    return pairs.select(
        "vec_id",
        r6(vectors.cosine_to_squared_l2(distance)).alias("squared_l2"),
        (F.abs(vectors.cosine_to_squared_l2(distance) - vectors.squared_l2("embedding", "q")) < 1e-5).alias("agrees"),
    )


def p15(spark, d):
    e = views.corpus_vectors(spark, d)
    halves = e.select("centroid_idx", vectors.half_precision("embedding").alias("half"), "embedding")
    error = F.array_max(F.zip_with("half", "embedding", lambda x, y: F.abs(x - y)))
    return halves.select("centroid_idx", (error <= 2.0**-11).alias("within_half_precision"))


def p15_values(spark, d):
    e = views.corpus_vectors(spark, d)
    values = e.select("centroid_idx", F.posexplode(vectors.half_precision("embedding")).alias("dim", "value"))
    return values.select("centroid_idx", "dim", F.col("value").cast("double").alias("value"))


def p16(spark, d):
    ids = views.membership(spark, d)
    return ids.select("centroid_id", "member_id", hashing.fnv1a32("centroid_id").alias("hash"))


def p17(spark, d):
    ids = views.membership(spark, d)
    return ids.select(
        "centroid_id",
        "member_id",
        hashing.bucket_dir("centroid_id").cast("long").alias("dir"),
        hashing.bucket_group("centroid_id").cast("long").alias("grp"),
    )


def p18(spark, d):
    """Both sides of the later join are placed by one rule: ids of members and proteins agree."""
    left = views.membership(spark, d).select("member_id", hashing.id_shard("member_id").alias("a"))
    right = stores.shard_corpus(views.raw_proteins(spark, d)).select(F.col("protein_id").alias("member_id"), F.col("shard").alias("b"))
    return left.join(right, "member_id").select("member_id", (F.col("a") == F.col("b")).alias("together"))


def p19(spark, d):
    e = views.corpus_vectors(spark, d).select("centroid_idx")
    shard, local = ranges.range_shard("centroid_idx", SHARD), ranges.local_index("centroid_idx", SHARD)
    return e.select("centroid_idx", shard.alias("shard"), local.alias("local_idx"), ranges.global_index(shard, local, SHARD).alias("again"))


def p20(spark, d):
    q = views.queries(spark, d)
    name = F.when(F.length("sequence") > 200, F.col("query_name"))
    return q.select("query_idx", headers.fallback_query_name(name, "query_idx").alias("query_name"))


def p21(spark, d):
    return views.table(spark, d, "documents").select("doc_id", headers.remove_whitespace("text").alias("packed"))


def p22(spark, d):
    pages = views.table(spark, d, "pages").select(headers.has_marker("html").alias("flag"))
    docs = views.table(spark, d, "documents").select(headers.has_marker("text").alias("flag"))
    return pages.unionByName(docs).groupBy("flag").agg(F.count("*").alias("n_records"))


# --- joins ----------------------------------------------------------------------------


def j01(spark, d):
    return _hits(spark, d)


def j01_cells(spark, d):
    """Every vector against every vector, both sides distributed."""
    e = views.corpus_vectors(spark, d)
    q = e.select(F.col("centroid_idx").alias("query_idx"), "embedding")
    return cells.cell_join(q, e, CUTOFF, with_squared_l2=True)


def j02(spark, d):
    return cells.ann_join(views.query_vectors(spark, d), views.corpus_vectors(spark, d), CUTOFF, pivots=64, probes=48)


def j02_stored(spark, d):
    """Complete search on a stored cell index."""
    path = scratch_path(spark, "j02")
    cells.build_cell_index(views.corpus_vectors(spark, d), path, pivots=32)
    return cells.ann_join(views.query_vectors(spark, d), cells.load_cell_index(spark, path), CUTOFF, probes=None)


def j02_quality(spark, d):
    """Against the exact join: pairs found that it does not have, and whether nine tenths of its pairs are found."""
    keys = ["centroid_idx", "query_idx", "distance"]
    near = j02(spark, d).withColumn("near", F.lit(1))
    both = near.join(_hits(spark, d).withColumn("exact", F.lit(1)), keys, "full")
    n_exact = F.count("exact")
    return both.agg((F.count("*") - n_exact).alias("n_wrong"), (F.count("near") >= 0.9 * n_exact).alias("enough"), n_exact.alias("n_exact"))


def j01_scattered(spark, d):
    """The similarity join with its limit for small query sets forced down."""
    return similarity.similarity_join(views.query_vectors(spark, d), views.corpus_vectors(spark, d), CUTOFF, max_broadcast_bytes=1)


def j03(spark, d):
    return hits.attach_sequences(_hits(spark, d), views.sequences(spark, d))


def j03_stored(spark, d):
    """Hits named from a stored sequence table, of which only matched ranges are read."""
    df = views.sequences(spark, d)
    stored = _written(spark, "j03", lambda p: stores.write_sequences(df, p, SHARD), lambda p: stores.read_sequences(spark, p))
    return hits.attach_sequences(_hits(spark, d), stored)


def j04(spark, d):
    return hits.attach_query_names(_hits(spark, d), views.query_vectors(spark, d))


def j05(spark, d):
    return hits.filter_aligned(_named(spark, d), _seed_centroids(spark, d))


def j06(spark, d):
    return mem.expand_members(_centroid_ids(spark, d), views.members(spark, d)).select("centroid_id", "member_header", "sequence")


PREFIX_DIRS, PREFIX_GROUPS = 4, 1


def j07_merged(spark, d):
    """The same with the limit for small id sets forced down: ids and headers sorted together."""
    return j07(spark, d, 0)


def j07(spark, d, limit=MAX_ID_BYTES):
    """Look members up by ids without their tail, placed in four buckets."""
    short = F.substring_index("centroid_id", "_", 1)
    placed = views.members(spark, d).withColumn("centroid_id", short)
    ids = _centroid_ids(spark, d).select(short.alias("centroid_id"))
    found = mem.expand_members(ids, placed, "prefix", PREFIX_DIRS, PREFIX_GROUPS, limit=limit)
    return found.select("lookup_id", "centroid_id", "member_header")


def j08(spark, d):
    return mem.matched_proteins(_proteins(spark, d), views.seed_alignments(spark, d))


def j09(spark, d):
    return views.members(spark, d)


def j10(spark, d):
    return views.seed_pairs(spark, d, 5)


def _seed_texts(spark, d):
    targets = views.sequences(spark, d, spread=True).select(F.col("centroid_idx").alias("target_idx"), "sequence")
    return targets, views.queries(spark, d).select("query_idx", "sequence")


def j10_spaced(spark, d):
    return seeds.spaced_candidates(*_seed_texts(spark, d), views.TEXT_SHAPE)


def j10_spaced_groups(spark, d):
    """The same with the limit of the index forced down: several groups of queries, a scan for each."""
    return seeds.spaced_candidates(*_seed_texts(spark, d), views.TEXT_SHAPE, max_index_bytes=400_000)


def j11(spark, d):
    return kmers.self_candidates(views.queries(spark, d), 6, 10)


# --- aggregates, ranks, orders --------------------------------------------------------


def a01(spark, d):
    return hits.matches_per_shard(_hits(spark, d), SHARD)


def a02(spark, d):
    """Counts of a chain of steps, observed while each step is written once."""
    steps = [
        ("queries", lambda **_: views.query_vectors(spark, d)),
        ("hits", lambda queries: similarity.similarity_join(queries, views.corpus_vectors(spark, d), CUTOFF)),
        ("named_hits", lambda queries, hits, h=hits: h.name_hits(hits, views.sequences(spark, d), queries)),
    ]
    return hits.staged(spark, steps)[1]


def a03(spark, d):
    return mem.distinct_members(j06(spark, d))


def a04(spark, d):
    return hits.distinct_centroid_sequences(_named(spark, d))


def a05(spark, d):
    ids = hits.distinct_centroids(j05(spark, d))
    matched = hits.distinct_matches(_hits(spark, d)).select(F.col("centroid_idx").cast("string").alias("centroid_id"))
    return ids.unionByName(matched)


def a06(spark, d):
    report = similarity.coverage(_neighbours(spark, d, 4), 4, CUTOFF)
    return report.select("query_idx", "shard", "max_distance", "n_returned", "saturated")


def a07(spark, d):
    grouped = hits.hits_by_centroid(_hits(spark, d))
    shown = F.transform("matches", lambda m: F.format_string("%d:%d", m["query_idx"], F.round(m["distance"] * 1e6).cast("long")))
    return grouped.select("centroid_idx", F.array_join(shown, ",").alias("matches"))


def a08(spark, d):
    return stats.rows_per_shard(views.membership(spark, d), "member_id")


def a08_totals(spark, d):
    per_shard = stats.rows_per_shard(views.membership(spark, d), "member_id")
    inside = F.col("shard").between(0, hashing.CORPUS_SHARDS - 1)
    return per_shard.agg(F.sum("n_rows").alias("n_rows"), F.count_if(~inside).alias("n_outside"))


def a09(spark, d):
    return stats.store_size(views.corpus_vectors(spark, d), SHARD)


def w01(spark, d):
    return hits.top_hit_per_target(views.seed_alignments(spark, d)).select(
        "target", "query", r6("evalue").alias("evalue"), "bitscore"
    )


def w02(spark, d):
    return _neighbours(spark, d, 5)


def w02_bounded(spark, d):
    """The nearest neighbours with the limit for small query sets forced down: near cells first, then those within the bound."""
    return similarity.nearest(views.query_vectors(spark, d), views.corpus_vectors(spark, d), 5, SHARD, max_broadcast_bytes=1)


def j01_index(spark, d):
    """The exact join over a stored index by cell."""
    path = scratch_path(spark, "j01-index")
    cells.build_cell_index(views.corpus_vectors(spark, d), path, pivots=64)
    return similarity.similarity_join(views.query_vectors(spark, d), cells.load_cell_index(spark, path), CUTOFF)


def w03(spark, d):
    return similarity.deepening_report(_hits(spark, d), SHARD, start=1, rounds=3)


def o01(spark, d):
    return hits.sort_hits(_hits(spark, d))


def o02(spark, d):
    return hits.sort_named_hits(_named(spark, d))


def o03(spark, d):
    return hits.sort_by_centroid(_named(spark, d))


def u01(spark, d):
    texts = similarity.similarity_join(_query_text_vectors(spark, d), _text_vectors(spark, d), TEXT_CUTOFF)
    return hits.union_hits(_hits(spark, d), texts)


def _text_vectors(spark, d):
    return embed(views.sequences(spark, d, spread=True), hashed_kmer_encoder(DIM)).select("centroid_idx", "embedding")


def _query_text_vectors(spark, d):
    return embed(views.queries(spark, d), hashed_kmer_encoder(DIM)).select("query_idx", "query_name", "embedding")


def u02(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id")
    labels = views.table(spark, d, "labels")
    inside = hits.ids_in(docs, labels, "doc_id").withColumn("labelled", F.lit(True))
    return inside.unionByName(hits.ids_not_in(docs, labels, "doc_id").withColumn("labelled", F.lit(False)))


def u03(spark, d):
    """The parts of all jobs together are the whole corpus."""
    df = views.sequences(spark, d, spread=True)
    path = scratch_path(spark, "u03")
    tables.write_fasta(df, "name", "sequence", path)
    parts = [fasta.read_fasta(spark, path, jobs=3, job=i) for i in range(3)]
    return hits.union_hits(*parts)


# --- kernels and jobs -----------------------------------------------------------------


def m01(spark, d):
    return _embedded(views.sequences(spark, d, spread=True))


def m02(spark, d):
    _, assignment = cluster.reduce_redundancy(views.queries(spark, d), k=6, min_shared=20)
    return assignment


def m03(spark, d):
    return al.align(*_text_pairs(spark, d), **ALIGN)


def m02_invariants(spark, d):
    """Representatives stand for themselves; every query has one owner, which is a representative."""
    reps, assignment = cluster.reduce_redundancy(views.queries(spark, d), k=6, min_shared=20)
    reps, assignment = through_table(reps.select("query_idx"), "reps"), through_table(assignment, "assignment")
    owner = next(c for c in assignment.columns if c != "query_idx")
    own = assignment.where(F.col(owner) == F.col("query_idx"))
    strangers = assignment.join(reps.withColumnRenamed("query_idx", owner), owner, "left_anti")
    parts = {
        "n_assigned": assignment.select("query_idx"), "n_repeated": assignment.groupBy("query_idx").count().where("count > 1"),
        "n_strangers": strangers, "n_not_own": reps.join(own, "query_idx", "left_anti"),
    }
    return hits.stage_counts(parts)


def m03_self(spark, d):
    """Every benchmark item against itself: the whole text, all letters equal."""
    _, probes = _text_pairs(spark, d)
    found = al.align(probes.withColumnRenamed("query", "target"), probes, max_evalue=None, **ALIGN).where("target = query")
    return found.withColumn("log_evalue", F.round(F.log("evalue"), 4)).drop("evalue")


def m03_violations(spark, d):
    """Alignments whose spans, counts, E-value and score do not fit each other, by kind; and targets that differ from m04's."""
    targets, probes = _text_pairs(spark, d)
    found = through_table(al.align(targets, probes, **ALIGN), "alignments")
    lengths = targets.select("target", F.length("sequence").alias("t_len"))
    both = found.join(lengths, "target").join(probes.select("query", F.length("sequence").alias("q_len")), "query")
    t_span, q_span = F.col("target_end") - F.col("target_start") + 1, F.col("query_end") - F.col("query_start") + 1
    matches = F.round(F.col("identity") * F.col("alignment_length"))
    gaps = F.col("alignment_length") - matches - F.col("nb_mismatches")
    evalue = F.log(F.col("t_len") * F.lit(float(al.total_length(probes)))) - F.col("bitscore") * F.log(F.lit(2.0))
    wrong = {
        "spans": (F.col("target_start") < 1) | (F.col("query_start") < 1) | (F.col("target_end") > F.col("t_len")) | (F.col("query_end") > F.col("q_len")),
        "columns": t_span + q_span != 2 * (matches + F.col("nb_mismatches")) + gaps,
        "gaps": (gaps < F.col("nb_gap_openings")) | (F.col("nb_gap_openings") < 0),
        "evalue": (F.abs(F.log("evalue") - evalue) > 1e-4) | (F.col("evalue") > al.MAX_EVALUE),
    }
    counted = both.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in wrong.items()))
    rows = counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n_wrong")) for k in wrong))).alias("x")).select("x.*")
    ids = found.select(headers.record_id(headers.strip_marker("target")).alias("centroid_id")).distinct().withColumn("a", F.lit(1))
    kept = m04(spark, d).withColumn("b", F.lit(1))
    differ = ids.join(kept, "centroid_id", "full").where("a is null or b is null").agg(F.count("*").alias("n_wrong"))
    return rows.unionByName(differ.select(F.lit("existence").alias("kind"), "n_wrong"))


def m04(spark, d):
    targets, probes = _text_pairs(spark, d)
    return al.aligned_centroids(targets.withColumnRenamed("target", "centroid_name"), probes, **ALIGN)


def f01(spark, d):
    path = scratch_path(spark, "f01")
    return _unpacked(build.build_index(views.sequences(spark, d, spread=True), hashed_kmer_encoder(DIM), path))


def f02(spark, d):
    return _search(spark, d).diversified_hits


def f02_alignments(spark, d):
    return _search(spark, d).alignments


def f02_top_hits(spark, d):
    return _search(spark, d).top_hits


def f02_reduced(spark, d):
    """A search that first drops queries which a longer one stands for: its hits are those of all queries, less those of the dropped ones."""
    options = {"k": 6, "min_shared": 20}
    # Texts are compared by their fixed-width identity.
    keys = ["query_name", "centroid_name", hashing.text_key("sequence").alias("text_id"), "distance"]
    db = _database(spark, d)
    found = job.search(
        views.queries(spark, d), db, TEXT_CUTOFF, load=hashed_kmer_encoder(DIM), reduce_queries=True, align_options=options
    ).diversified_hits
    found, whole = through_table(found.select(*keys), "reduced-hits"), through_table(_search(spark, d, db).diversified_hits.select(*keys), "hits")
    reps, _ = cluster.reduce_redundancy(views.queries(spark, d), **options)
    kept = whole.join(reps.select("query_name"), "query_name", "left_semi")
    extra, missing = hits.differences(found, kept)
    wrong = {"extra": extra, "missing": missing, "none": found.limit(1)}
    counts = hits.stage_counts(wrong)
    return counts.select(F.col("stage").alias("kind"), F.when(F.col("stage") == "none", 1 - F.col("n_rows")).otherwise(F.col("n_rows")).alias("n_wrong"))


def f02_top_checked(spark, d):
    """Top hits against the best row of each target by a join on the best values."""
    found = _search(spark, d)
    best = found.alignments.groupBy("target").agg(F.min("evalue").alias("evalue"), F.count("*").alias("n"))
    both = best.join(found.top_hits.withColumn("top", F.lit(1)), ["target", "evalue"], "full")
    return both.agg(F.count_if(F.col("n").isNull() | F.col("top").isNull()).alias("n_wrong"), (F.count("*") > 0).alias("any"))


def f03(spark, d):
    return _search(spark, d, deep=True).proteins


def f04(spark, d):
    """A build that stopped after the labelled documents is resumed over all of them."""
    path = scratch_path(spark, "f04")
    docs = views.sequences(spark, d, spread=True)
    labelled = views.table(spark, d, "labels").select(F.col("doc_id").alias("centroid_idx"))
    build.build_index(hits.ids_in(docs, labelled, "centroid_idx"), hashed_kmer_encoder(DIM), path)
    return _unpacked(build.build_index(docs, hashed_kmer_encoder(DIM), path, resume=True))


def f05(spark, d):
    """The second search reads the query vectors that the first one stored."""
    path = scratch_path(spark, "f05")
    job.query_vectors(views.queries(spark, d), hashed_kmer_encoder(DIM), path, reduce_queries=False)
    return _search(spark, d, query_embeddings=path).diversified_hits


def f08(spark, d):
    path = scratch_path(spark, "f08")
    store = build.build_member_store(views.raw_proteins(spark, d), views.membership(spark, d), path, 16, 64)
    return store.select("centroid_id", "member_id", "member_header", "sequence")


def t01(spark, d):
    source, store, checkpoint = (scratch_path(spark, f"t01-{part}") for part in ("source", "store", "checkpoint"))
    tables.write_fasta(views.sequences(spark, d, spread=True), "name", "sequence", source)
    embed_stream(spark, source, store, checkpoint, hashed_kmer_encoder(DIM)).awaitTermination()
    vectors_by_name = spark.read.parquet(store)
    values = vectors_by_name.select("name", F.size("embedding").alias("dims"), F.posexplode("embedding").alias("dim", "value")).where("value <> 0")
    return values.select("name", "dims", "dim", r6(F.col("value").cast("double")).alias("value"))


NAMES = {
    "s01_fasta_scan": s01, "s02_compressed_fasta_scan": s02, "s02_zstd_frames_scan": s02_frames, "s04_half_vectors_scan": s04, "s03_fasta_glob_scan": s03, "s05_membership_scan": s05,
    "s06_hits_scan": s06, "s07_alignment_scan": s07, "s08_query_embeddings_scan": s08,
    "k01_diversified_hits": k01, "k02_hit_fasta": k02, "k03_unique_centroid_fasta": k03, "k04_member_fasta": k04,
    "k05_matched_fasta": k05, "k06_alignment_table": k06, "k07_top_hit_table": k07, "k08_sharded_corpus": k08,
    "k09_embedding_store": k09, "k10_member_store": k10, "k11_query_embedding_store": k11,
    "p01_distance_cutoff": p01, "p02_validation_report": p02, "p03_drop_comments": p03, "p04_record_id": p04,
    "p05_truncate_header": p05, "p06_member_header": p06, "p07_composite_header": p07, "p08_model_text": p08,
    "p09_strip_marker": p09, "p10_normalise": p10, "p11_unit_norm": p11, "p12_cosine_distance": p12, "p13_squared_l2": p13,
    "p14_metric_conversion": p14, "p15_half_precision": p15, "p15_half_precision_values": p15_values, "p16_fnv1a32": p16, "p17_bucket_coordinates": p17,
    "p18_id_shard": p18, "p19_range_shard": p19, "p20_fallback_query_name": p20, "p21_remove_whitespace": p21, "p22_marker_flag": p22,
    "j01_similarity_join": j01, "j01_similarity_cells": j01_cells, "j01_similarity_scattered": j01_scattered, "j01_similarity_index": j01_index, "j02_approximate_quality": j02_quality,
    "j02_approximate_join": j02, "j02_stored_cells": j02_stored, "j03_attach_sequences": j03, "j03_stored_sequences": j03_stored, "j04_attach_query_names": j04, "j05_filter_aligned": j05,
    "j06_expand_members": j06, "j07_expand_members_prefix": j07, "j07_prefix_merge": j07_merged, "j08_matched_proteins": j08, "j09_build_members": j09,
    "j10_kmer_candidates": j10, "j10_spaced_candidates": j10_spaced, "j10_spaced_groups": j10_spaced_groups, "j11_self_candidates": j11,
    "a01_matches_per_shard": a01, "a02_stage_counts": a02, "a03_distinct_members": a03, "a04_distinct_centroid_sequences": a04,
    "a05_distinct_centroids": a05, "a06_search_coverage": a06, "a07_hits_by_centroid": a07, "a08_rows_per_shard": a08, "a08_shard_totals": a08_totals, "a09_store_size": a09,
    "w01_top_hit_per_target": w01, "w02_nearest_per_shard": w02, "w02_nearest_bounded": w02_bounded, "w03_deepening_report": w03,
    "o01_sort_hits": o01, "o02_sort_named_hits": o02, "o03_sort_by_centroid": o03,
    "u01_union_hits": u01, "u02_id_sets": u02, "u03_job_split": u03,
    "m01_embed": m01, "m02_reduce_redundancy": m02, "m02_reduction_invariants": m02_invariants, "m03_self_alignment": m03_self, "m03_alignment_violations": m03_violations, "m03_align": m03, "m04_aligned_centroids": m04,
    "f01_build_index": f01, "f02_search": f02, "f02_search_alignments": f02_alignments, "f02_search_top_hits": f02_top_hits, "f02_search_reduced": f02_reduced, "f02_top_hits_checked": f02_top_checked,
    "f03_deep_search": f03, "f04_resume_build": f04, "f05_reuse_query_embeddings": f05, "f08_build_member_store": f08,
    "t01_incremental_embedding": t01,
}


def _shipping(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: _shipping(run) for name, run in NAMES.items()}
    return own | (text_queries.queries() if text_queries else {})


def oracle_sql() -> dict[str, str]:
    from oracle import sql_by_query

    return sql_by_query() | (text_queries.oracle_sql() if text_queries else {})
