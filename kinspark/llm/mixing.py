"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import attach, bind
from kinspark.session import through_table

TEMPERATURE = 0.7
# Mean of one draw at most: the first probability, exp(-mean), must not vanish.
MAX_RATE = 500.0
_DIGITS = 13


def hashed(digits: int, *parts: Column | str) -> Column:
    """A number of so many hexadecimal digits from the MD5 sum of the parts, the same in every engine."""
    words = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(words), 1, digits), 16, 10).cast("long")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1)."""
    return hashed(_DIGITS, *parts) / F.lit(float(1 << 4 * _DIGITS))


def _last(rate: Column) -> Column:
    return F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... for a mean ``rate``, far into the tail."""
    last = _last(rate)
    zero = F.exp(-rate)
    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), (state["c"] + p).alias("c"), F.concat(state["all"], F.array(state["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["all"])


def source_rates(docs: DataFrame, source: str = "source", text: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """Mean repetitions of a document by source, so that each source's share of the characters is its weight.

    ``weights`` are target shares (of any sum; sources that are not named get none); by default
    a source weighs its number of characters to the power ``TEMPERATURE``. The rates keep the
    expected number of characters. A source without any character has rate 1; a small source
    among large ones may have any rate. Returns the source, ``_rate``, ``_draws`` (into how many equal
    parts of at most ``MAX_RATE`` the rate is split) and ``_table`` (cumulative probabilities of a part).
    """
    sizes = docs.groupBy(source).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("_mass"))
    if weights is None:
        weight = F.pow(F.col("_mass").cast("double"), F.lit(TEMPERATURE))
    else:
        pairs = [F.lit(x) for name, share in weights.items() for x in (name, float(share))]
        weight = F.coalesce(F.create_map(*pairs)[F.col(source)], F.lit(0.0)) if pairs else F.lit(0.0)
        weight = F.when(F.col("_mass") > 0, weight).otherwise(0.0)
    sizes = through_table(sizes.withColumn("_weight", weight), "source-sizes")
    total = sizes.agg(F.sum("_mass").alias("m"), F.sum("_weight").alias("w")).first()
    mass, weight = float(total["m"] or 0), float(total["w"] or 0)
    rate = F.when(F.col("_mass") == 0, 1.0).otherwise(F.col("_weight") * F.lit(mass) / (F.lit(weight or 1.0) * F.col("_mass")))
    rated = through_table(sizes.select(source, rate.alias("_rate")), "source-rates")
    draws = F.greatest(F.ceil(F.col("_rate") / MAX_RATE), F.lit(1)).cast("int")
    return rated.withColumn("_draws", draws).withColumn("_table", poisson_table(F.col("_rate") / F.col("_draws")))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = 17,
    partitions: int | None = None,
    numbered: bool = True,
) -> DataFrame:
    """Repeat every document a Poisson number of times with its source's mean, and shuffle all copies.

    The number of copies inverts the Poisson distribution at a uniform number hashed from the
    seed and the key, so it does not depend on partitioning or retries. Beyond a mean of
    ``MAX_RATE`` it is the sum of several such draws of equal means, which has the same distribution. Each copy gets a hash of
    seed, key and copy number, by which all copies are dealt to tasks and sorted within them.

    Returns the columns of ``docs`` and, if ``numbered``, ``copy_number`` (from 1) and
    ``mix_order``; columns of ``docs`` of these names are replaced then. Only per-source sums
    leave the scan before that shuffle; a source of any size is spread over all tasks. Null
    sources form one source; null keys hash as one key; rows with equal keys get equal numbers
    of copies; an empty table gives no rows.
    """
    names = [c for c in docs.columns if not (numbered and c in ("copy_number", "mix_order"))]
    rows = docs.select(F.struct(*names).alias("_row"), F.col(source).alias("_source"))
    rated = source_rates(docs, source, text, weights).withColumnRenamed(source, "_source")
    length = rated.agg(F.avg(_last(F.col("_rate") / F.col("_draws")) + 1)).first()[0] or 0
    rows = attach(rows, rated, "_source", width=64 + int(8 * length))
    id_ = F.col("_row").getField(key)
    inverted = lambda u: F.size(F.filter(F.col("_table"), lambda c: c <= u))
    copies = bind(uniform(str(seed), id_), inverted)
    further = F.transform(F.sequence(F.lit(2), F.col("_draws")), lambda k: bind(uniform(f"{seed}/draw", id_, k), inverted))
    copies = F.when(F.col("_draws") > 1, F.aggregate(further, copies, lambda a, c: a + c)).otherwise(copies)
    rows = rows.withColumn("_copies", copies).where("_copies > 0").drop("_table", "_draws", "_rate")
    rows = rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    rows = rows.withColumn("_order", hashed(15, f"{seed}/order", F.col("_row").getField(key), F.col("_copy")))
    # Null and repeated keys have one order for a copy number; their texts still spread them over tasks.
    place = ("_order", F.xxhash64(F.col("_row").getField(text)))
    spread = rows.repartition(*place) if partitions is None else rows.repartition(partitions, *place)
    spread = spread.sortWithinPartitions("_order")
    added = [F.col("_copy").alias("copy_number"), F.col("_order").alias("mix_order")] if numbered else []
    return spread.select(*(F.col("_row").getField(c).alias(c) for c in names), *added)
