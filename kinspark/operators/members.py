"""Representatives and the proteins they stand for."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kinspark.functions.hashing import BUCKET_DIRS, BUCKET_GROUPS, bucket_dir, bucket_group
from kinspark.functions.headers import member_name, record_id, strip_marker
from kinspark.operators.skew import MAX_ID_BYTES, SALTS, measured_ids, salted_join


def build_members(membership: DataFrame, corpus: DataFrame) -> DataFrame:
    """Join the dictionary to the corpus: ``centroid_id, member_id, member_header, sequence``.

    The header of a member starts with the id of its representative. This is a plain
    equi-join: it needs no exchange on tables bucketed by ``member_id``, and adaptive
    execution splits an id that is crowded on either side.
    """
    proteins = corpus.select(F.col("protein_id").alias("member_id"), "header", "sequence")
    return membership.join(proteins, "member_id").select(
        "centroid_id",
        "member_id",
        F.concat_ws("_", "centroid_id", "header").alias("member_header"),
        "sequence",
    )


def expand_members(
    centroids: DataFrame,
    members: DataFrame,
    match: str = "exact",
    dirs: int = BUCKET_DIRS,
    groups: int = BUCKET_GROUPS,
    store_dirs: int | None = None,
    limit: int = MAX_ID_BYTES,
) -> DataFrame:
    """Members of each representative; one without members gives no row.

    ``match="exact"`` compares ids. ``match="prefix"`` also takes members whose header
    starts with the id and whose representative lies in the same hash bucket, which is what
    a text search in a bucket file finds; a set of ids of up to ``limit`` bytes is looked up in one
    pass over the members, a larger one is sorted together with their headers. Of a member store, which knows its number of
    folders, only folders of wanted ids are read; ``store_dirs`` may confirm that number.
    """
    if "n_dirs" in members.columns:
        first = members.select("n_dirs").first()
        members = members.drop("n_dirs")
        if first is not None:
            if store_dirs not in (None, first.n_dirs):
                raise ValueError(f"the member store has {first.n_dirs} folders, not {store_dirs}")
            store_dirs = first.n_dirs
    elif store_dirs is not None:
        raise ValueError("only a member store has folders")
    if match == "prefix":
        return _expand_by_prefix(centroids, members, dirs, groups, limit)
    if match != "exact":
        raise ValueError(f"unknown match {match!r}")
    wanted, small = measured_ids(centroids, "centroid_id", limit)
    if store_dirs is not None:
        # At most one value per folder of the store.
        found = wanted.select(bucket_dir("centroid_id", store_dirs).alias("dir")).distinct().collect()
        members = members.where(F.col("dir").isin([r.dir for r in found]))
    if small:
        return members.join(F.broadcast(wanted), "centroid_id", "left_semi")
    return salted_join(members, wanted, "centroid_id", "left_semi")


def expand_bucketed_members(centroids: DataFrame, members: DataFrame) -> DataFrame:
    """``expand_members`` for two tables bucketed by ``centroid_id``: joined in place."""
    return members.join(centroids.select("centroid_id"), "centroid_id", "left_semi")


def _expand_by_prefix(wanted: DataFrame, members: DataFrame, dirs: int, groups: int, limit: int) -> DataFrame:
    wanted, small = measured_ids(wanted.where("centroid_id is not null"), "centroid_id", limit)
    ids = wanted.select(F.col("centroid_id").alias("lookup_id"), bucket_dir("centroid_id", dirs).alias("_dir"), bucket_group("centroid_id", dirs, groups).alias("_grp"))
    names = members.columns
    placed = members.withColumns({"_dir": bucket_dir("centroid_id", dirs), "_grp": bucket_group("centroid_id", dirs, groups), "_header": strip_marker("member_header")})
    if small:
        # One pass over the members: only lengths that occur are cut off. At most one value per length of an id.
        lengths = sorted(r[0] for r in ids.select(F.length("lookup_id")).distinct().collect())
        cut = [F.when(F.length("_header") >= n, F.substring("_header", 1, n)) for n in lengths]
        prefixed = placed.withColumn("lookup_id", F.explode(F.array(*cut))) if cut else placed.limit(0).withColumn("lookup_id", F.lit(""))
        return prefixed.join(F.broadcast(ids), ["lookup_id", "_dir", "_grp"]).select("lookup_id", *names)
    return _merge_by_prefix(ids, placed, names)


def _merge_by_prefix(ids: DataFrame, placed: DataFrame, names: list[str]) -> DataFrame:
    """Ids and headers of a bucket, sorted together: the headers that begin with an id follow it.

    Members of a bucket are spread over salts, and ids are repeated for each, so a bucket with
    a large share of all members is many tasks. A task holds the ids that the current header may still begin with.
    """
    salt = F.pmod(F.xxhash64("_header"), F.lit(SALTS)).cast("int")
    left = ids.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumns({"_header": F.col("lookup_id"), "_member": F.lit(None)})
    right = placed.select("_dir", "_grp", salt.alias("_salt"), "_header", F.struct(*names).alias("_member")).withColumn("lookup_id", F.lit(None).cast("string"))
    keys = ["_dir", "_grp", "_salt"]
    both = left.select(*keys, "_header", "lookup_id", F.col("_member").cast(right.schema["_member"].dataType)).unionByName(right.select(*keys, "_header", "lookup_id", "_member"))
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "_header", F.col("lookup_id").asc_nulls_last())

    def merge(batches):
        bucket, open_ids = None, []
        for batch in batches:
            rows, found = [], []
            places = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for row, (place, header, own) in enumerate(zip(places, batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if header is None:
                    continue
                if place != bucket:
                    bucket, open_ids = place, []
                while open_ids and not header.startswith(open_ids[-1]):
                    open_ids.pop()
                if own is not None:
                    open_ids.append(own)
                else:
                    rows += [row] * len(open_ids)
                    found += open_ids
            arrays = [pa.array(found, pa.string()), batch.column(5).take(pa.array(rows, pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["lookup_id", "_member"])

    schema = StructType([StructField("lookup_id", StringType()), right.schema["_member"]])
    return dealt.mapInArrow(merge, schema).select("lookup_id", *(F.col("_member").getField(c).alias(c) for c in names))


def distinct_members(expanded: DataFrame) -> DataFrame:
    """Distinct (header, sequence); the header names the representative, so a protein under two of them stays twice."""
    return expanded.select("member_header", "sequence").distinct()


def protein_headers(expanded: DataFrame) -> DataFrame:
    """``protein_header, sequence``: the member part of each header, as used in alignments."""
    return expanded.select(member_name("member_header").alias("protein_header"), "sequence")


def matched_proteins(proteins: DataFrame, alignments: DataFrame, limit: int = MAX_ID_BYTES) -> DataFrame:
    """Proteins whose full header or whose first token is an alignment target."""
    targets, small = measured_ids(alignments.select(strip_marker("target").alias("_key")), "_key", limit)
    token = record_id("protein_header")
    if small:
        # One pass over the proteins.
        full = F.broadcast(targets.select(F.col("_key").alias("_full"), F.lit(True).alias("_by_header")))
        first = F.broadcast(targets.select(F.col("_key").alias("_first"), F.lit(True).alias("_by_token")))
        marked = proteins.join(full, F.col("protein_header") == F.col("_full"), "left").join(
            first, token == F.col("_first"), "left"
        )
        return marked.where(F.col("_by_header") | F.col("_by_token")).select(*proteins.columns)

    by_header = proteins.withColumn("_key", F.col("protein_header"))
    # Only headers with more than one token can match by token alone.
    longer = by_header.where(token != F.col("protein_header"))
    unmatched = salted_join(longer, targets, "_key", "left_anti").withColumn("_key", token)
    found = salted_join(by_header, targets, "_key", "left_semi")
    return found.unionByName(salted_join(unmatched, targets, "_key", "left_semi")).drop("_key")
