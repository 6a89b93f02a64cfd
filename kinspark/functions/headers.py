"""Column functions on record headers and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER_FIELDS = 7
STRAND_TOKEN = "<+>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_marker(header) -> Column:
    """Drop every leading ``>``."""
    return F.ltrim(_col(header), F.lit(">"))


def record_id(header) -> Column:
    """First whitespace-separated token of a header."""
    return F.regexp_extract(_col(header), r"^\s*(\S+)", 1)


def truncate_header(header, fields: int = HEADER_FIELDS) -> Column:
    """Keep the first ``fields`` space-separated fields."""
    return F.substring_index(_col(header), " ", fields)


def remove_whitespace(text) -> Column:
    return F.regexp_replace(_col(text), r"\s+", "")


def _long_form(header: Column) -> Column:
    return F.size(F.split(record_id(header), "_")) >= 4


def member_accession(header) -> Column:
    """Representative a member header belongs to, under both header layouts.

    ``A_7_1_M_2_1 # …`` (four or more ``_`` parts in the first token) names it in the
    first three parts, ``A_7_1 M_2_1 # …`` in the first token.
    """
    h = strip_marker(header)
    return F.when(_long_form(h), F.substring_index(h, "_", 3)).otherwise(record_id(h))


def member_name(header) -> Column:
    """The rest of a member header after its accession, without any whitespace."""
    h = strip_marker(header)
    after_parts = F.substring(h, F.length(F.substring_index(h, "_", 3)) + 2, F.length(h))
    after_token = F.regexp_replace(h, r"^\s*\S+", "")
    return remove_whitespace(F.when(_long_form(h), after_parts).otherwise(after_token))


def composite_header(*parts) -> Column:
    return F.concat_ws("#", *[_col(p) for p in parts])


def model_text(sequence) -> Column:
    """Input of an embedding model: strand token, then the sequence without trailing stops."""
    return F.concat(F.lit(STRAND_TOKEN), F.rtrim(_col(sequence), F.lit("*")))


def fallback_query_name(name, query_idx) -> Column:
    return F.coalesce(_col(name), F.concat(F.lit("query_"), _col(query_idx).cast("string")))


def has_marker(sequence) -> Column:
    """Quality flag: the sequence holds a ``>``, so a record was probably cut badly."""
    return F.contains(_col(sequence), F.lit(">"))


def drop_comments(df: DataFrame, column: str) -> DataFrame:
    """Drop blank rows and rows that start with ``#``."""
    c = F.col(column)
    return df.where((F.trim(c) != "") & ~c.startswith("#"))
