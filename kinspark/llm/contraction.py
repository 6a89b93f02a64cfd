"""Subtree totals of a forest by parallel tree contraction: rake, compress, and expand again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.session import through_table

MAX_ROUNDS = 400


def subtree_totals(forest: DataFrame, values: list[str]) -> DataFrame:
    """``id`` and the sum of each of ``values`` over the node and all below it.

    ``forest`` has one row per node: ``id`` (unique, never null), ``parent`` (the id of another
    node; null for a top) and the numbers ``values`` (null counts as 0). Every round rakes all leaves,
    adding them to their parents, and compresses chains of nodes with one child: of
    neighbours in a chain the ones with the locally least hash are spliced out, their child
    then hangs from their parent and carries their sum along. Both shrink the tree by a
    share, so rounds grow with the logarithm of its size, for a path as for a star. Spliced
    nodes get their totals afterwards, round by round backwards, from the child that took their
    place. Sums of a node's children are added up before the shuffle, so a node with a third
    of all nodes below it is no hot group. Every round is a written table. An empty
    forest gives no rows; a parent that does not exist counts as a top.
    """
    kind = dict(forest.dtypes)["id"]
    known_parents = forest.select(F.col("id").alias("parent")).withColumn("_there", F.lit(True))
    tree = forest.join(known_parents, "parent", "left")
    tree = tree.select("id", F.when(F.col("_there"), F.col("parent")).cast(kind).alias("parent"), *(F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in values))
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    state = tree.join(children, "id", "left").select("id", "parent", F.coalesce("n", F.lit(0)).alias("n"), *values, *(F.lit(0).cast("long").alias(f"e_{v}") for v in values))
    state = through_table(state, "tree")
    rounds: list[DataFrame] = []
    while not rounds or not rounds[-1].where("gone = ''").isEmpty():
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("the tree did not contract: its parents form a cycle")
        rounds.append(through_table(_round(state, values, len(rounds)), "round"))
        state = _moved(rounds[-1], values)
    return _expanded(rounds, values, tree)


def _round(state: DataFrame, values: list[str], number: int) -> DataFrame:
    """Every node with its leaves added, its heir (the child left, if there is one alone) and whether it goes."""
    heir = F.struct("id", *(F.col(f"e_{v}") for v in values))
    leaf = F.col("n") == 0
    below = state.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.when(leaf, 1)).alias("raked"),
        F.min(F.when(~leaf, heir)).alias("heir"),
        *(F.sum(F.when(leaf, F.col(v) + F.col(f"e_{v}")).otherwise(0)).alias(f"r_{v}") for v in values),
    )
    joined = state.join(below, "id", "left")
    left = F.col("n") - F.coalesce("raked", F.lit(0))
    chance = [F.xxhash64(F.lit(number), c) for c in ("parent", "id", "heir.id")]
    chain = (F.col("n") > 0) & (left == 1) & F.col("parent").isNotNull() & (chance[1] < chance[0]) & (chance[1] < chance[2])
    gone = F.when(leaf, "raked").when(chain, "spliced").otherwise("")
    return joined.select("id", "parent", left.alias("n"), *((F.col(v) + F.coalesce(f"r_{v}", F.lit(0))).alias(v) for v in values), *(f"e_{v}" for v in values), "heir", gone.alias("gone"))


def _moved(done: DataFrame, values: list[str]) -> DataFrame:
    """The nodes that stay; children of spliced nodes hang one higher and carry their sums."""
    spliced = done.where("gone = 'spliced'").select(F.col("id").alias("parent"), F.col("parent").alias("_above"), *((F.col(v) + F.col(f"e_{v}")).alias(f"s_{v}") for v in values))
    kept = done.where("gone = ''").select("id", "parent", "n", *values, *(f"e_{v}" for v in values)).join(spliced, "parent", "left")
    carried = ((F.col(f"e_{v}") + F.coalesce(f"s_{v}", F.lit(0))).alias(f"e_{v}") for v in values)
    return kept.select("id", F.coalesce("_above", "parent").alias("parent"), "n", *values, *carried)


def _expanded(rounds: list[DataFrame], values: list[str], tree: DataFrame) -> DataFrame:
    """Totals of raked nodes, which are whole, then of spliced ones, from the last round to the first."""
    known = tree.select("id", *values).limit(0)
    for r in rounds:
        known = known.union(r.where("gone = 'raked'").select("id", *values))
    for r in reversed(rounds):
        spliced = r.where("gone = 'spliced'").select(F.col("id").alias("_id"), F.col("heir.id").alias("id"), *((F.col(v) + F.col(f"heir.e_{v}")).alias(f"s_{v}") for v in values))
        if not spliced.isEmpty():
            found = spliced.join(known, "id").select(F.col("_id").alias("id"), *((F.col(v) + F.col(f"s_{v}")).alias(v) for v in values))
            known = known.union(through_table(found, "expanded"))
    return known
