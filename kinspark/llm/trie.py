"""Prefix trie of conversations: shared beginnings, and what keeping each of them once would save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinspark.llm.contraction import subtree_totals
from kinspark.llm.digests import ordered_digest
from kinspark.session import through_table

FAMILY = 100
HEADS = 6


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``seq`` (from 1), ``role`` and ``text`` in order of the turn, null first, ties by role and text.

    Rows without a ``conv_id`` belong to no conversation and are left out; a null role or
    text is empty.
    """
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("seq"), "role", "text")


def share_beginnings(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first of their family, and their ids.

    Conversation ``c`` begins with the first ``h = crc32(c) % heads`` turns of conversation
    ``c - c % family`` (fewer or none if it has no more) and goes on with its own turns after its first
    ``h``. ``turns`` is from ``ranked_turns``. The first result has ``conv_id``, ``pos`` (from 1), ``role`` and ``text``,
    the second ``conv_id`` of every conversation, those without turns too. At most
    ``family`` times ``heads - 1`` turns are taken from one conversation.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % family
    convs = sizes.select("conv_id", h.alias("h"), first.alias("base")).join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("_n")), "base", "left")
    convs = convs.select("conv_id", "base", "h", F.least("h", F.coalesce("_n", F.lit(0))).cast("int").alias("m"))
    own = turns.withColumn("h", h).where("seq > h").join(convs.select("conv_id", "m"), "conv_id")
    own = own.select("conv_id", (F.col("seq") - F.col("h") + F.col("m")).alias("pos"), "role", "text")
    taken = turns.where(F.col("seq") < heads).withColumnRenamed("conv_id", "base").join(convs.where("m > 0").select("conv_id", "base", "h"), "base").where("seq <= h")
    return own.union(taken.select("conv_id", F.col("seq").alias("pos"), "role", "text")), convs.select("conv_id")


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def prefix_nodes(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and the node at which each conversation ends.

    A node is known by its depth and two 60-bit sums (exclusive or) over hashes of position,
    role and text of its turns. The first result has ``conv_id`` (the smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs`` and ``chars`` (code points of the last text), the second ``conv_id``,
    ``end_conv_id`` and ``depth``. One conversation is sorted within one task, which spills.
    """
    digest = F.md5(F.concat_ws("\0", F.col("pos").cast("string"), F.length("role").cast("string"), "role", "text"))
    steps = turns.select("conv_id", F.col("pos").alias("depth"), _half(digest, 1).alias("a"), _half(digest, 16).alias("b"), F.length("text").alias("chars"))
    upto = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = steps.select("*", F.bit_xor("a").over(upto).alias("k1"), F.bit_xor("b").over(upto).alias("k2"))
    steps = steps.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("a")).alias("p1"), F.col("k2").bitwiseXOR(F.col("b")).alias("p2"), "chars")
    zero = F.lit(0).cast("long")
    tops = ids.select("conv_id", F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), F.lit(0).alias("chars"))
    steps = through_table(steps.union(tops), "steps")
    key = ["depth", "k1", "k2"]
    nodes = steps.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("p1", "p2", "chars")))
    nodes = through_table(nodes, "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    lasts = steps.groupBy("conv_id").agg(F.max_by(F.struct(*key), "depth").alias("last")).select("conv_id", "last.*")
    ends = lasts.join(nodes.select(*key, F.col("conv_id").alias("end_conv_id")), key)
    found = nodes.join(parents, ["depth", "p1", "p2"], "left")
    found = found.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "chars")
    return found, ends.select("conv_id", "end_conv_id", "depth")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row per node of the trie of all conversations, after ``share_beginnings``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the top), ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` over the subtree, and ``ends_sha256`` of the members that end here. Sums over
    subtrees come from tree contraction. Null roles and texts count as empty, rows without a
    ``conv_id`` are left out, repeated rows are turns of their own, further columns are ignored. No conversations, no nodes.
    """
    turns = through_table(ranked_turns(conversations), "turns")
    nodes, ends = prefix_nodes(*share_beginnings(turns, family, heads))
    node, above = F.struct("conv_id", "depth"), F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    tree = nodes.select(node.alias("id"), F.when(F.col("depth") > 0, above).alias("parent"), "n_convs", "chars")
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    tree = tree.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = through_table(tree.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}), "trie")
    totals = subtree_totals(tree.select("id", "parent", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    ends = ends.withColumn("member", F.col("conv_id").cast("string"))
    hashes = ordered_digest(ends, ["end_conv_id", "depth"], ["conv_id"], "member", "ends_sha256")
    hashes = hashes.select(F.struct(F.col("end_conv_id").alias("conv_id"), "depth").alias("id"), "ends_sha256")
    joined = tree.select("id", "parent", "n_convs", "n_children").join(totals, "id").join(hashes, "id", "left")
    return joined.select(
        "id.conv_id", F.col("id.depth").cast("long").alias("depth"), F.col("parent.conv_id").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
