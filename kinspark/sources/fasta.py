"""FASTA corpora: plain or compressed, one or many files, multi-line sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.functions.hashing import id_shard
from kinspark.functions.headers import strip_marker

WHITESPACE = " \t\n\x0b\f\r"


def join_lines(text: Column) -> Column:
    """Trimmed lines joined without a separator."""
    return F.btrim(F.regexp_replace(text, r"[ \t\x0B\f\r]*+\n\s*", ""), F.lit(WHITESPACE))


def _record_name(value: Column) -> Column:
    first_line = F.substring_index(value, "\n", 1)
    return F.btrim(strip_marker(first_line), F.lit(WHITESPACE))


def _record_sequence(value: Column) -> Column:
    return join_lines(F.substring(value, F.length(F.substring_index(value, "\n", 1)) + 2, F.length(value)))


def parse_records(raw: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Turn raw ``value`` records (text up to the next ``\\n>``) into ``name, sequence``.

    Other columns of ``raw`` are kept. A record without a sequence is dropped together
    with its name unless ``drop_empty`` is off (to count such records).
    """
    others = [c for c in raw.columns if c != "value"]
    records = raw.where(F.trim("value") != "").select(
        _record_name(F.col("value")).alias("name"), _record_sequence(F.col("value")).alias("sequence"), *others
    )
    return records.where(F.length("sequence") > 0) if drop_empty else records


def read_fasta(
    spark: SparkSession,
    path: str | list[str],
    glob: str | None = None,
    with_file: bool = False,
    drop_empty: bool = True,
    jobs: int | None = None,
    job: int = 0,
) -> DataFrame:
    """Scan FASTA files into ``name, sequence``.

    ``path`` may be a file, a folder or a pattern; ``glob`` filters by file name; with
    ``jobs`` only the files whose name hashes to ``job`` are read. Plain files are split
    by Spark at record borders; ``.zst`` and ``.gz`` files take one task each, so
    repartition after the scan when they are few and large.
    """
    reader = spark.read.option("lineSep", "\n>")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path)
    if with_file or jobs:
        raw = raw.select("value", F.col("_metadata.file_name").alias("file_name"))
    if jobs:
        raw = raw.where(id_shard("file_name", jobs) == job)
        if not with_file:
            raw = raw.drop("file_name")
    return parse_records(raw, drop_empty)


def read_indexed_fasta(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Scan FASTA files into ``centroid_idx, name, sequence``, numbered in file order.

    The key of a record is its position over all files, ordered by path; positions of
    records without a sequence stay unused. A first narrow pass counts the records of each
    file split, a second adds the split's offset to the position inside it, so the corpus
    itself is neither sorted nor shuffled.
    """
    reader = spark.read.option("lineSep", "\n>")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # About one row per 128 MB of input.
    splits = raw.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    numbered = raw.join(offsets.drop("_n", "_first"), ["_file", "_start"])
    keyed = numbered.select((F.col("_row") + F.col("_offset")).cast("long").alias("centroid_idx"), "value")
    return parse_records(keyed).select("centroid_idx", "name", "sequence")


def headerless_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files whose first record has no header line: they hold one record more than headers."""
    file = F.col("_metadata.file_path").alias("file_path")
    records = (
        spark.read.option("lineSep", "\n>").text(path).select("value", file).where(F.trim("value") != "")
        .groupBy("file_path").agg(F.count("*").alias("n_records"))
    )
    headers = (
        spark.read.text(path).select("value", file)
        .groupBy("file_path").agg(F.count_if(F.col("value").startswith(">")).alias("n_headers"))
    )
    return records.join(headers, "file_path").where("n_records > n_headers")
