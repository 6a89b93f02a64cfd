"""Document fingerprints: a Merkle tree over sections, paragraphs and their sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinspark.llm.common import bind

# Splits keep every character: joined again, the parts are the text.
SECTION = "(?<=\\n\\n)"
PARAGRAPH = "(?<=\\n)"
SENTENCE = "(?<=[.!?;] )"
ROWS_PER_RANGE = 4000
MAX_RANGES = 1 << 14


def _node(children: Column) -> Column:
    return F.md5(F.concat_ws(",", children))


def tree(text: Column) -> Column:
    """The Merkle tree of a whole text: ``root``, ``sections``, ``paragraphs`` and ``leaves``.

    Leaves are 64-bit hashes of sentences; a paragraph's node is the MD5 sum of its leaves, a
    section's that of its paragraphs, the root the SHA-256 sum of the sections' nodes and the
    text's length. Equal roots mean equal texts; differing nodes on one level tell where two
    texts differ. Null counts as the empty text, which has one empty leaf.
    """

    def paragraph(p: Column) -> Column:
        return F.transform(F.split(p, SENTENCE, -1), lambda x: F.xxhash64(x))

    def section(s: Column) -> Column:
        return F.transform(F.split(s, PARAGRAPH, -1), paragraph)

    def built(nested: Column) -> Column:
        paragraphs = F.transform(nested, lambda s: F.transform(s, lambda p: _node(p.cast("array<string>"))))

        def above(nodes: Column) -> Column:
            sections = F.transform(nodes, _node)
            return bind(
                sections,
                lambda s: F.struct(
                    F.sha2(F.concat_ws("/", F.length(text).cast("string"), s), 256).alias("root"),
                    s.alias("sections"),
                    F.flatten(nodes).alias("paragraphs"),
                    F.flatten(F.flatten(nested)).alias("leaves"),
                ),
            )

        return bind(paragraphs, above)

    text = F.coalesce(text, F.lit(""))
    return bind(F.transform(F.split(text, SECTION, -1), section), built)


def fingerprint(t: Column) -> Column:
    """A tree as text: the root, then its leaves in order (eight hexadecimal digits each)."""
    digits = F.transform(t["leaves"], lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << 32))), 8, "0"))
    return F.concat(t["root"], F.lit(":"), F.lower(F.concat_ws("", digits)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct leaves of two trees (arrays of leaves) that both have."""
    return (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).cast("double")


def differing(a: Column, b: Column, level: str = "paragraphs") -> Column:
    """Nodes of one level of tree ``a`` that tree ``b`` does not have: where the texts differ."""
    return F.array_except(a[level], b[level])


def range_bounds(docs: DataFrame, key: str, rows_per_range: int = ROWS_PER_RANGE) -> tuple[list[int], int | None, bool]:
    """Keys that cut the table into ranges of about equal numbers of rows, the least key, and whether a key is null.

    The number of ranges grows with the table up to ``MAX_RANGES``, which bounds what the
    driver holds; ranges only set how work is dealt out, never what is computed.
    """
    first = docs.agg(F.count("*").alias("n"), F.min(key).alias("least"), F.count(key).alias("known")).first()
    ranges = min(MAX_RANGES, max(1, -(-first["n"] // rows_per_range)))
    bounds: list[int] = []
    if ranges > 1 and first["known"]:
        shares = F.split(F.lit(",".join(repr(k / ranges) for k in range(1, ranges))), ",").cast("array<double>")
        found = docs.agg(F.percentile_approx(key, shares, F.lit(max(1000, 4 * ranges))).alias("b")).first()["b"]
        bounds = sorted({b for b in found if b > first["least"]})
    return bounds, first["least"], first["known"] < first["n"]


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by bisection."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def move(at: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(table, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), move)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Key, ``text`` (null as empty), its ``tree``, and ``next`` (text and leaves) of the next row by ascending key.

    After the last row comes the first; equal keys are ordered by text; null keys come first.
    One shuffle deals rows out by ranges of keys. The row at a range's lower end is also sent
    to the range before, where it only serves as what comes next.
    """
    bounds, least, has_null = range_bounds(docs, key, rows_per_range)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own = F.when(F.col("_key").isNull(), 0).otherwise(range_of(F.col("_key"), bounds))
    first = F.col("_key").isNull() if has_null else F.col("_key") == least if least is not None else F.lit(False)
    # (range, wraps, own row): the row itself, and what it is next to in the range before.
    places = [F.struct(F.col("_own").alias("r"), F.lit(0).alias("w"), F.lit(True).alias("o"))]
    if bounds:
        cut = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
        at_cut = (F.col("_own") > 0) & (F.get(cut, F.col("_own") - 1) == F.col("_key"))
        places.append(F.when(at_cut, F.struct((F.col("_own") - 1).alias("r"), F.lit(0).alias("w"), F.lit(False).alias("o"))))
    places.append(F.when(first, F.struct(F.lit(len(bounds)).alias("r"), F.lit(1).alias("w"), F.lit(False).alias("o"))))
    rows = rows.withColumn("_own", own).withColumn("_at", F.explode(F.array_compact(F.array(*places))))
    rows = rows.select("_key", "_text", "_at.r", "_at.w", "_at.o").repartition("r")
    rows = rows.withColumn("_tree", tree(F.col("_text")))
    order = W.partitionBy("r").orderBy("w", F.col("_key").asc_nulls_first(), "_text")
    after = F.lead(F.struct(F.col("_text").alias("text"), F.col("_tree.leaves").alias("leaves"))).over(order)
    rows = rows.withColumn("_next", after).where("o")
    return rows.select(F.col("_key").alias(key), F.col("_text").alias("text"), F.col("_tree").alias("tree"), F.col("_next").alias("next"))


def compare_with_edit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of an edit of it, and how alike fingerprints are.

    The edited text is the text with its last half (rounded down) replaced by as many first
    characters of the next row's text, or all of it. Returns the key, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``
    and ``n_edited_paragraphs`` (distinct paragraphs
    that the edited text lacks). Equal texts have equal fingerprints.
    """
    rows = with_next(docs, key, text)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select(key, n.cast("long").alias("n_chars"), "tree", F.col("next.leaves").alias("_after"), edited.alias("_edited"))

    def compared(b: Column) -> Column:
        a = F.col("tree")
        return F.struct(
            fingerprint(b).alias("print"), likeness(a["leaves"], b["leaves"]).alias("near"), F.size(differing(a, b)).cast("long").alias("n_differ")
        )

    rows = rows.withColumn("_e", bind(tree(F.col("_edited")), compared))
    return rows.select(
        key, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), fingerprint(F.col("tree")).alias("fingerprint"),
        F.col("_e.print").alias("edited_fingerprint"), F.col("_e.near").alias("near_edited"),
        likeness(F.col("tree.leaves"), F.col("_after")).alias("near_next"), F.col("_e.n_differ").alias("n_edited_paragraphs"),
    )
