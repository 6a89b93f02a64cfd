"""Line-oriented tables: membership dictionary, hit tables, alignment tables, FASTA output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions.headers import composite_header, drop_comments, member_accession, member_name

# Fixed column names and types of the alignment table.
ALIGNMENT_COLUMNS = {
    "target": "string",
    "query": "string",
    "identity": "double",
    "alignment_length": "int",
    "nb_mismatches": "int",
    "nb_gap_openings": "int",
    "target_start": "int",
    "target_end": "int",
    "query_start": "int",
    "query_end": "int",
    "evalue": "double",
    "bitscore": "double",
}
ALIGNMENT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in ALIGNMENT_COLUMNS.items())

# Fixed header lines of the two result tables.
HITS_HEADER = "#query_name\tresult_name\tresult_sequences\tcosine_distance"
ALIGNMENT_HEADER = "#" + "\t".join(ALIGNMENT_COLUMNS)

HIT_COLUMNS = {"query_name": "string", "centroid_name": "string", "sequence": "string", "distance": "double"}


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """Scan ``centroid member`` lines, split at the first space; lines without one are skipped."""
    lines = spark.read.text(path)
    space = F.instr("value", " ")
    return lines.where(space > 0).select(
        F.substring_index("value", " ", 1).alias("centroid_id"),
        F.substring(F.col("value"), space + 1, F.length("value")).alias("member_id"),
    )


def _read_tsv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    # Plain split instead of the CSV reader: names may hold quotes, and the last field may hold tabs.
    fields = F.split("value", "\t", len(columns))
    return drop_comments(spark.read.text(path), "value").select(
        *[F.try_element_at(fields, F.lit(i + 1)).cast(kind).alias(name) for i, (name, kind) in enumerate(columns.items())]
    )


def read_hits_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _read_tsv(spark, path, HIT_COLUMNS)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return _read_tsv(spark, path, ALIGNMENT_COLUMNS)


def _tsv_line(df: DataFrame, columns) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _write_tsv(df: DataFrame, columns, path: str, header: str | None, mode: str) -> None:
    lines = df.select(_tsv_line(df, columns).alias("value"))
    if header is not None:
        # The union keeps partition order: the header is the first part file, and the parts
        # read one after the other give the whole table in its order.
        first = df.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value"))
        lines = first.union(lines)
    lines.write.mode(mode).text(path)


def write_diversified_hits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All named hits in total order (query, distance, representative), aligned or not."""
    ordered = df.orderBy("query_name", "distance", "centroid_name")
    _write_tsv(ordered, HIT_COLUMNS, path, HITS_HEADER, mode)


def write_alignments(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    _write_tsv(df, ALIGNMENT_COLUMNS, path, ALIGNMENT_HEADER if header else None, mode)


def fasta_record(header: Column, sequence: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), sequence)


def write_fasta(df: DataFrame, header, sequence, path: str, mode: str = "errorifexists") -> None:
    h = F.col(header) if isinstance(header, str) else header
    s = F.col(sequence) if isinstance(sequence, str) else sequence
    df.select(fasta_record(h, s).alias("value")).write.mode(mode).text(path)


def write_hit_fasta(named_hits: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per hit, header ``representative#query``."""
    write_fasta(named_hits, composite_header("centroid_name", "query_name"), "sequence", path, mode)


def write_member_fasta(members: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per member protein, header ``member#representative``."""
    header = composite_header(member_name("member_header"), member_accession("member_header"))
    write_fasta(members, header, "sequence", path, mode)
