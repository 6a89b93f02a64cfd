"""Joins that hold up when one key has a large share of all rows, or one side is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.session import through_table

SALTS = 16
MAX_ID_BYTES = 64 * 1024 * 1024
ID_OVERHEAD = 64


def salted_join(
    many: DataFrame, one: DataFrame, on: str | list[str], how: str = "inner", spread: Column | None = None, salts: int = SALTS
) -> DataFrame:
    """Join ``many``, whose keys may be hot, to ``one``, which has few rows per key.

    Where Spark splits skewed partitions itself (adaptive execution, the default), this is a
    plain join: partitions of ``many`` that turn out large are cut, and only their part of
    ``one`` is repeated. Without it rows of ``many`` are spread over ``salts`` tasks per key by
    a hash of ``spread`` (by default of the columns of fixed width), and ``one``
    is repeated for each. ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``, with
    ``many`` on the left.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not support {how}")
    conf = many.sparkSession.conf
    if all(conf.get(f"spark.sql.adaptive.{s}", "true") == "true" for s in ("enabled", "skewJoin.enabled")):
        return many.join(one, keys, how)
    narrow = [c for c, kind in many.dtypes if kind not in ("string", "binary")] or many.columns
    spread = F.xxhash64(*narrow) if spread is None else F.xxhash64(spread)
    left = many.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def measured_ids(ids: DataFrame, key: str, limit: int = MAX_ID_BYTES) -> tuple[DataFrame, bool]:
    """Distinct ids as a written table, and whether they are few enough to send to every task."""
    distinct = through_table(ids.select(key).distinct(), "ids")
    width = F.length(F.col(key).cast("string")) + ID_OVERHEAD
    return distinct, (distinct.agg(F.sum(width)).first()[0] or 0) <= limit


def restrict(big: DataFrame, ids: DataFrame, key: str, limit: int = MAX_ID_BYTES) -> DataFrame:
    """Rows of ``big`` whose ``key`` is in ``ids``.

    The ids are counted first: a small set goes to every task and ``big`` is filtered where
    it is read, without a shuffle; a large one is joined with the keys of ``big`` spread.
    """
    distinct, small = measured_ids(ids, key, limit)
    if small:
        return big.join(F.broadcast(distinct), key, "left_semi")
    return salted_join(big, distinct, key, "left_semi")
