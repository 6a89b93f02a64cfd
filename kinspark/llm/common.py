"""Column and join helpers of the operators that stay within DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.operators.skew import salted_join

# ASCII white space: space, and tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
SMALL_BYTES = 32 * 1024 * 1024


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, although ``use`` names it within lambdas."""
    return F.transform(F.array(value), use).getItem(0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def attach(rows: DataFrame, facts: DataFrame, key: str, width: int = 256, limit: int = SMALL_BYTES) -> DataFrame:
    """Left join to one row of ``facts`` per ``key`` (null counts as a value), however many rows share a key.

    ``facts`` is counted: while it takes at most ``limit`` bytes at ``width`` bytes a row it
    goes to every task, beyond that the rows of a key are dealt out over salts.
    """
    names = rows.columns
    lone = F.struct(F.col(key).isNull().alias("n"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("v"))
    others = [c for c in facts.columns if c != key]
    left, right = rows.withColumn("_k", lone), facts.select(lone.alias("_k"), *others)
    if facts.count() * width <= limit:
        joined = left.join(F.broadcast(right), "_k", "left")
    else:
        joined = salted_join(left, right, "_k", "left", spread=F.monotonically_increasing_id())
    return joined.select(*names, *others)
