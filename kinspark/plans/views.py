"""Search inputs derived from the provided tables, in whole.

Documents stand for representatives and proteins, documents with equal text for the members
of one representative, benchmark items for the queries, embeddings for the vector store,
and the mean vector of each label for a batch of query vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions.hashing import text_key
from kinspark.operators.members import build_members
from kinspark.operators.skew import ID_OVERHEAD, MAX_ID_BYTES, measured_ids, salted_join
from kinspark.operators.kmers import kmer_candidates
from kinspark.operators.seeds import SeedShape
from kinspark.session import through_table
from kinspark.sources.fasta import join_lines
from kinspark.sources.stores import shard_corpus

SEED_K = 12
# Rows of a file that Spark's bitmaps hold, and their bytes.
MAP_ROWS, MAP_BYTES = 32_768, 4_096
# Seeds for texts, whose common words repeat far more than stretches of proteins do.
TEXT_SHAPE = SeedShape(patterns=("111101110111101", "1101110110111011"), apart=16, reach=64)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One input table. ``spread`` deals a table that has fewer splits than there are cores out to
    all of them, for work that costs far more than moving the rows; larger tables stay as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _spread(df, df) if spread else df


def _spread(df: DataFrame, scan: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if scan.rdd.getNumPartitions() < cores else df


def without_ids(df: DataFrame, ids: DataFrame, key: str, limit: int = MAX_ID_BYTES) -> DataFrame:
    """Rows of a table, just read from its files, whose ``key`` is not null and not in ``ids``, which may be any number.

    Keys and places in the files alone are shuffled. The rows to leave out are sent to the tasks that read the
    files as bitmaps, a bit a row, so up to some hundred million rows stay in the tasks that read them.
    """
    row = F.col("_metadata.row_index")
    places = {"_file": F.col("_metadata.file_path"), "_map": F.floor(row / MAP_ROWS), "_bit": (row % MAP_ROWS).cast("int")}
    placed = df.where(F.col(key).isNotNull()).withColumns(places)
    out = salted_join(placed.select(key, *places), ids, key, "left_semi")
    maps = through_table(out.groupBy("_file", "_map").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "row-maps")
    size = maps.agg(F.sum(F.length("_file") + ID_OVERHEAD + MAP_BYTES)).first()[0] or 0
    octet = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    both = placed.join(F.broadcast(maps) if size <= limit else maps, ["_file", "_map"], "left")
    return both.where(F.col("_bits").isNull() | (F.bit_get(octet, F.col("_bit") % 8) == 0)).select(*df.columns)


def one_line(text: str) -> Column:
    """A text as a FASTA scan returns it."""
    return join_lines(F.col(text))


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("centroid_idx"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label."""
    values = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "value"))
    means = values.groupBy("label", "pos").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    ordered = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("dims"))
    return ordered.select(
        F.col("label").cast("long").alias("query_idx"),
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("query_name"),
        F.transform("dims", lambda d: d["mean"]).cast("array<float>").alias("embedding"),
    )


def centroid_name() -> Column:
    return F.concat(F.lit("DOC"), F.col("doc_id").cast("string"), F.lit("_"), F.col("source"), F.lit("_1 "), F.col("lang"))


def sequences(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread)
    return docs.select(F.col("doc_id").alias("centroid_idx"), centroid_name().alias("name"), one_line("text").alias("sequence"))


def repeated_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """Ids of documents whose text a smaller id has too, and whether they are few enough to send to every task.

    Only ids and identities of texts are shuffled."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(text_key("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return measured_ids(docs.select("doc_id").where("doc_id is not null").join(first, "doc_id", "left_anti"), "doc_id")


def representatives(spark: SparkSession, sf_dir: str, spread: bool = False, repeated: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """One record per distinct text, keyed and named by its smallest document id.

    The repeated texts (``repeated_texts``, worked out here if not given) are left out where the documents are read."""
    docs = table(spark, sf_dir, "documents")
    ids, small = repeated_texts(spark, sf_dir) if repeated is None else repeated
    name = F.concat(F.lit("C"), F.col("doc_id").cast("string"), F.lit("_7_1 "), F.col("lang"))
    if small:
        kept = table(spark, sf_dir, "documents", spread).where("doc_id is not null").join(F.broadcast(ids), "doc_id", "left_anti")
    else:
        kept = without_ids(docs, ids, "doc_id")
        kept = _spread(kept, docs) if spread else kept
    return kept.select(F.col("doc_id").alias("centroid_idx"), name.alias("name"), one_line("text").alias("sequence"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(
        F.col("item_id").alias("query_idx"),
        F.concat(F.lit("Q"), F.col("item_id").cast("string")).alias("query_name"),
        one_line("text").alias("sequence"),
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text under the smallest id among them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_key("text").alias("text_id"))
    groups = docs.groupBy("text_id").agg(F.min("doc_id").alias("first_id"))
    owned = salted_join(docs, groups, "text_id", spread=F.col("doc_id"))
    return owned.select(
        F.concat(F.lit("C"), F.col("first_id").cast("string"), F.lit("_7_1")).alias("centroid_id"),
        F.concat(F.lit("M"), F.col("doc_id").cast("string")).alias("member_id"),
    )


def raw_proteins(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Records as they come in, with more header fields than are kept."""
    name = F.concat(
        F.lit("M"), F.col("doc_id").cast("string"), F.lit(" # "), F.col("n_chars").cast("string"), F.lit(" # 1 # 1 # tail")
    )
    return table(spark, sf_dir, "documents", spread).select(name.alias("name"), one_line("text").alias("sequence"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_members(membership(spark, sf_dir), shard_corpus(raw_proteins(spark, sf_dir)))


def seed_pairs(spark: SparkSession, sf_dir: str, min_shared: int = 1, k: int = SEED_K) -> DataFrame:
    """k-mer seed counts of all documents against all queries."""
    targets = sequences(spark, sf_dir, spread=True).select(F.col("centroid_idx").alias("target_idx"), "sequence")
    return kmer_candidates(targets, queries(spark, sf_dir).select("query_idx", "sequence"), k, min_shared)


def seed_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic stand-in for an alignment table: score and E-value from the seed count."""
    pairs = seed_pairs(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("target_idx"),
        F.concat(F.lit("M"), F.col("doc_id").cast("string"), F.lit("#"), F.col("n_chars").cast("string"), F.lit("#1#1")).alias("target"),
    )
    one = F.lit(1)
    return pairs.join(docs, "target_idx").select(
        "target",
        F.concat(F.lit("Q"), F.col("query_idx").cast("string")).alias("query"),
        F.lit(1.0).alias("identity"),
        F.col("shared").cast("int").alias("alignment_length"),
        F.lit(0).alias("nb_mismatches"),
        F.lit(0).alias("nb_gap_openings"),
        one.alias("target_start"),
        F.col("shared").cast("int").alias("target_end"),
        one.alias("query_start"),
        F.col("shared").cast("int").alias("query_end"),
        (F.lit(1.0) / F.col("shared")).alias("evalue"),
        F.col("shared").cast("double").alias("bitscore"),
    )
