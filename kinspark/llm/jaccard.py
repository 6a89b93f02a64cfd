"""Exact Jaccard joins of word-shingle sets by rare-first prefix filtering, and the groups they form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinspark.llm.components import connected_components
from kinspark.llm.text import mix, shingle_sets, slices, texts
from kinspark.operators.skew import measured_ids
from kinspark.session import through_table

WORDS = 5
PERCENT = 75
# Buckets of the table of shingle frequencies: 4 MB whatever the corpus.
FREQUENCY_BITS = 20
_CHUNKS = 64
BANDS, BAND_BINS = 4, 3
# Rows of one shingle that are compared in one task; longer lists are cut into blocks.
BLOCK_ROWS = 2048
_U = np.uint64


@dataclass(frozen=True)
class Threshold:
    """Sets are linked when 100 * intersection >= percent * union."""

    percent: int = PERCENT

    def least_overlap(self, a, b):
        """Smallest intersection of linked sets of sizes ``a`` and ``b``."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def probe_prefix(self, n):
        """Rarest shingles of a set of ``n`` among which any linked set has one in its own prefix."""
        return n - (-(-self.percent * n // 100)) + 1

    def index_prefix(self, n):
        """The same for the smaller set of a pair."""
        return n - (-(-2 * self.percent * n // (100 + self.percent))) + 1


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        column = texts(batch.column(1))
        for a, b in slices(column):
            yield batch.column(0).slice(a, b - a), shingle_sets(column.slice(a, b - a), WORDS)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) >> _U(64 - FREQUENCY_BITS)).astype(np.int64)


def _bands(shingles: np.ndarray) -> list[int]:
    """Hashes of groups of bin minima: sets with much in common share some, others hardly any."""
    bins = BANDS * BAND_BINS
    mixed = np.sort(mix(shingles ^ _U(0xA5A5A5A5A5A5A5A5)))
    edges = (np.arange(bins, dtype=_U) * _U((1 << 64) // bins)).astype(_U)
    at = np.searchsorted(mixed, edges)
    minima = np.where(at < len(mixed), mixed[np.minimum(at, len(mixed) - 1)], _U(0)).reshape(BANDS, BAND_BINS)
    with np.errstate(over="ignore"):
        keys = minima[:, 0] * _U(3) + mix(minima[:, 1]) * _U(5) + mix(mix(minima[:, 2])) + np.arange(BANDS, dtype=_U)
    return mix(keys).view(np.int64).tolist()


def profile(docs: DataFrame) -> DataFrame:
    """Per document the set's size, identity and bands, and in rows of their own the shingle counts of each task.

    Counts are by hash bucket, so they take 4 MB per task and cover every shingle of every
    document.
    """

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << FREQUENCY_BITS, np.uint32)
        names = ["id", "n", "set_key", "bands", "chunk", "counts"]
        kind = None
        for ids, sets in _batches(batches):
            kind = ids.type
            everything = np.concatenate(sets) if sets else np.zeros(0, _U)
            counts += np.bincount(_bucket(everything), minlength=len(counts)).astype(np.uint32)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = [_bands(s) if len(s) else None for s in sets]
            nothing = [None] * len(sets)
            arrays = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(nothing, pa.int32()), pa.array(nothing, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)
        if counts.any():
            parts = [p.tobytes() for p in np.split(counts, _CHUNKS)]
            nothing = [None] * _CHUNKS
            arrays = [pa.array(nothing, kind), pa.array(nothing, pa.int64()), pa.array(nothing, pa.binary()), pa.array(nothing, pa.list_(pa.int64())), pa.array(range(_CHUNKS), pa.int32()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return through_table(docs.mapInArrow(profiled, "id long, n long, set_key binary, bands array<long>, chunk int, counts binary"), "profiles")


def frequencies(profiles: DataFrame) -> np.ndarray:
    """Sums of the tasks' counts, chunk by chunk, as one table of fixed size."""

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << FREQUENCY_BITS) // _CHUNKS, np.uint64)
        for batch in batches:
            for c in batch.column(1):
                total += np.frombuffer(c.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], ["chunk", "counts"])

    parts = profiles.where("chunk is not null").select("chunk", "counts")
    table = np.zeros((_CHUNKS, (1 << FREQUENCY_BITS) // _CHUNKS), np.uint32)
    for r in parts.groupBy("chunk").applyInArrow(added, "chunk int, counts binary").collect():
        table[r["chunk"]] = np.frombuffer(bytes(r["counts"]), np.uint32)
    return table.ravel()


def prefix_rows(docs: DataFrame, counts: np.ndarray, threshold: Threshold) -> DataFrame:
    """The prefix of every document: its rarest shingles (ties by hash) with their position.

    Sizes of linked sets differ by a quarter at most, so rows also carry the set's size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for ids, sets in _batches(batches):
            tokens, positions, sizes = [], [], []
            for s in sets:
                n = len(s)
                k = threshold.probe_prefix(n) if n else 0
                if k:
                    order = np.lexsort((s, table[_bucket(s)]))[:k]
                    tokens.append(s[order])
                positions.append(np.arange(k, dtype=np.int32))
                sizes.append(k)
            lengths = np.array([len(s) for s in sets], np.int32)
            token = np.concatenate(tokens) if tokens else np.zeros(0, _U)
            owner = np.repeat(np.arange(len(sets)), sizes)
            arrays = [pa.array(token.view(np.int64)), ids.take(pa.array(owner)), pa.array(lengths[owner]), pa.array(np.concatenate(positions) if positions else np.zeros(0, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["token", "id", "n", "pos"])

    return docs.mapInArrow(prefixes, "token long, id long, n int, pos int")


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold every run of equal keys (of sorted rows) as a whole."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        same = np.ones(table.num_rows, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            same &= column == column[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _run_ids(*columns: np.ndarray) -> np.ndarray:
    changed = np.zeros(len(columns[0]), bool)
    changed[0] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.cumsum(changed) - 1


def shared_rows(rows: DataFrame) -> DataFrame:
    """Prefix rows whose shingle is in another document's prefix too; rows stream by sorted, so a run needs no memory."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: int | None = None  # shingle of the row held back
        held: pa.RecordBatch | None = None
        repeated = False
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column(0).to_numpy()
            like_last = np.concatenate(([token[0] == before if before is not None else False], token[1:] == token[:-1]))
            like_next = np.concatenate((like_last[1:], [False]))
            if held is not None and (repeated or like_last[0]):
                yield held
            keep = (like_last | like_next)[:-1]
            body = batch.slice(0, batch.num_rows - 1)
            if keep.any():
                yield body.filter(pa.array(keep))
            held, before, repeated = batch.slice(batch.num_rows - 1), int(token[-1]), bool(like_last[-1])
        if held is not None and repeated:
            yield held

    return rows.repartition("token").sortWithinPartitions("token", "id").mapInArrow(shared, rows.schema)


def candidate_pairs(rows: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs of documents (``a`` < ``b``) of different components that share a prefix shingle and may be linked.

    Shingles of one component alone are left out. A shingle's rows, sorted by size, are compared within one task while they are at most
    ``BLOCK_ROWS``; a longer list is cut into blocks, of which every two meet in a task of
    their own. A pair must pass the length filter (sizes), the shorter prefix of the smaller
    set, and the positional filter (what can still follow the shared shingle). Pairs are
    distinct in the result.
    """
    spans = rows.groupBy("token").agg(F.count("*").alias("c"), F.min("component").alias("_low"), F.max("component").alias("_high"))
    rows = rows.join(spans.where("_low <> _high").select("token", "c"), "token")
    blocks = F.ceil(F.col("c") / BLOCK_ROWS).cast("int")
    rows = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("token", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "id", "n", "pos", "component")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, ["token", "i", "j"]):
            token, i, j, own, id_, n, pos, component = (table.column(k).to_numpy() for k in range(8))
            run = _run_ids(token, i, j)
            found = []
            at = np.arange(len(run))
            step = 0
            while len(at):
                step += 1
                at = at[at + step < len(run)]
                at = at[run[at] == run[at + step]]
                other = at + step  # not smaller than the row at ``at``
                ok = component[at] != component[other]
                ok &= (i[at] == j[at]) | (own[at] != own[other])
                a, b = at[ok], other[ok]
                small, large = n[a].astype(np.int64), n[b].astype(np.int64)
                ok = (100 * small >= threshold.percent * large) & (pos[a] < threshold.index_prefix(small))
                ok &= 1 + np.minimum(small - pos[a] - 1, large - pos[b] - 1) >= threshold.least_overlap(small, large)
                a, b = id_[a[ok]], id_[b[ok]]
                if len(a):
                    found.append(np.stack((np.minimum(a, b), np.maximum(a, b)), 1))
            if found:
                both = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    dealt = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "id")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()


def suffix_distance(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """Lower bound of the number of elements in one of two sorted sets only.

    Both are split at the larger one's median, as often as ``depth``; differing sizes of the
    parts cannot be made up for.
    """
    if not depth or not len(a) or not len(b):
        return abs(len(a) - len(b))
    pivot = b[len(b) // 2]
    x, y = np.searchsorted(a, pivot), len(b) // 2
    return suffix_distance(a[:x], b[:y], depth - 1) + suffix_distance(a[x:], b[y:], depth - 1)


def verified(pairs: DataFrame, docs: DataFrame, threshold: Threshold) -> DataFrame:
    """Those pairs that are linked, with ``overlap`` and ``union_size``; each pair's sets are compared once.

    Only documents in a pair are read again; their sets are written once and joined to both
    sides. The suffix filter rejects a pair before its sets are intersected.
    """
    pairs = through_table(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    ids, small = measured_ids(wanted, "id")
    chosen = docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _batches(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in found], pa.binary())], ["id", "shingles"])

    stored = through_table(chosen.mapInArrow(sets, "id long, shingles binary"), "shingle-sets")
    sides = [stored.select(F.col("id").alias(s), F.col("shingles").alias(f"s{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, overlaps, unions = [], [], []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                total = len(x) + len(y)
                least = threshold.least_overlap(len(x), len(y))
                if suffix_distance(x, y) > total - 2 * least:
                    continue
                merged = np.sort(np.concatenate((x, y)))
                overlap = int((merged[1:] == merged[:-1]).sum())
                if 100 * overlap >= threshold.percent * (total - overlap):
                    keep.append(k)
                    overlaps.append(overlap)
                    unions.append(total - overlap)
            picked = pa.array(keep, pa.int64())
            arrays = [batch.column(0).take(picked), batch.column(1).take(picked), pa.array(overlaps, pa.int64()), pa.array(unions, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "overlap", "union_size"])

    return through_table(both.mapInArrow(compared, "a long, b long, overlap long, union_size long"), "links")


@dataclass(frozen=True)
class JaccardGroups:
    """``members``: id, n_shingles, representative, component of every document; ``links``: between representatives."""

    members: DataFrame
    links: DataFrame


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, all_links: bool = False) -> JaccardGroups:
    """Link documents whose sets of five-word shingles have a Jaccard similarity of ``percent`` or more, and group them.

    1. Documents with equal sets form a class, represented by the least id; only
       representatives are compared.
    2. Representatives that share a band of bin minima are compared with the least of them: a
       crowd of near copies becomes one group by as many comparisons as it has members. This
       step only saves work; what it misses is found by the next.
    3. The exact join: every set's rarest shingles are matched, and pairs that pass the length,
       positional and suffix filters are verified. Pairs already in one group are left out
       (unless ``all_links``), because no link between them can change the groups.

    Links are between representatives; without ``all_links`` they are enough to connect every
    group, and with it they are all links between different sets. Words are split at ASCII
    white space, ASCII capitals count as small; fewer than five words are one shingle. Null and
    empty texts, and texts of white space, have no shingles and are linked with nothing: they
    are groups of their own. Repeated rows of one id count as one document in the join and keep
    their rows in ``members``; rows with null ids have null components. An empty table gives
    empty tables; other columns are not read.
    """
    threshold = Threshold(percent)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    profiles = profile(rows)
    own = profiles.where("chunk is null").select("id", "n", "set_key")
    counts = frequencies(profiles)
    known = profiles.where("set_key is not null and id is not null")
    classes = known.groupBy("set_key").agg(F.min("id").alias("representative"), F.min(F.struct("id", "bands")).alias("_first"))
    classes = through_table(classes.select("set_key", "representative", F.col("_first.bands").alias("bands")), "classes")
    representatives = classes.select(F.col("representative").alias("id"))

    banded = classes.select("representative", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("representative").alias("a"), F.count("*").alias("c")).where("c > 1").select("band", "a")
    stars = banded.join(hubs, "band").where("representative <> a").select("a", F.col("representative").alias("b")).distinct()
    near = verified(stars, rows, threshold)
    first = connected_components(near.select("a", "b"))

    copies = own.where("set_key is not null").select("id").join(representatives, "id", "left_anti")
    dropped, small = measured_ids(copies, "id")
    single = rows.where("id is not null").join(F.broadcast(dropped) if small else dropped, "id", "left_anti")
    shared = through_table(shared_rows(prefix_rows(single, counts, threshold)), "shared-prefixes")
    if all_links:
        shared = shared.withColumn("component", F.col("id"))
    else:
        shared = shared.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    links = verified(candidate_pairs(shared, threshold), rows, threshold)
    links = links if all_links else links.unionByName(near)
    final = connected_components(links.select("a", "b"))

    named = classes.select("set_key", "representative").join(final, classes["representative"] == final["id"], "left")
    named = named.select("set_key", "representative", F.coalesce("component", "representative").alias("component"))
    members = own.join(named, "set_key", "left")
    members = members.select("id", F.col("n").alias("n_shingles"), F.coalesce("representative", "id").alias("representative"), F.coalesce("component", "id").alias("component"))
    return JaccardGroups(members, links)


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the least key, with all its columns.

    Texts without shingles stay. Of repeated rows of one key one stays (the least by text).
    Rows with a null key stay.
    """
    members = through_table(jaccard_groups(docs, key, text, percent).members, "members")
    copies, small = measured_ids(members.where("id <> component"), "id")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(F.broadcast(copies) if small else copies, "id", "left_anti")
    counts = members.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1")
    repeated, few = measured_ids(counts, "id")
    if not repeated.isEmpty():
        ids = F.broadcast(repeated) if few else repeated
        order = W.partitionBy("id").orderBy(F.col("text").asc_nulls_last())
        first = kept.join(ids, "id", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
        kept = kept.join(ids, "id", "left_anti").unionByName(first)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
