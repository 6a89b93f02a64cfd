"""k-mer seed joins: pairs of sequences that share at least a number of distinct k-mers.

A query set of checked, bounded size is indexed once and sent to every task; each target is
looked up whole, and shared k-mers are counted per query, so a k-mer found everywhere costs
no more than any other. Beyond that size both sides are joined on their rarer k-mers only
(a pair sharing ``m`` k-mers shares one outside the ``m - 1`` most frequent of either
side), and each candidate pair is then counted exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinspark.functions.hashing import text_key
from kinspark.operators.skew import salted_join

DEFAULT_K = 6
DEFAULT_MIN_SHARED = 2
MAX_INDEX_BYTES = 64 * 1024 * 1024
BYTES_PER_KMER = 24
CHARACTERS_PER_BATCH = 16 * 1024 * 1024
# Texts of a batch that are Python strings at one time.
ROWS_AT_ONCE = 256
SEEN_BITS = 20
SEEN_SHIFT = np.uint64(64 - SEEN_BITS)


def _pairs_schema(targets: DataFrame, queries: DataFrame, keep_sequence: bool = False) -> T.StructType:
    fields = [
        T.StructField("target_idx", targets.schema["target_idx"].dataType),
        T.StructField("query_idx", queries.schema["query_idx"].dataType),
        T.StructField("shared", T.LongType()),
    ]
    return T.StructType(fields + [T.StructField("sequence", T.StringType())] * keep_sequence)


def kmer_set(sequence: str, k: int) -> set[str]:
    return {sequence[i : i + k] for i in range(len(sequence) - k + 1)}


def explode_kmers(df: DataFrame, key: str, k: int) -> DataFrame:
    """``key, kmer``: the distinct k-mers of each sequence.

    Cut in Python, because finding the i-th character of a UTF-8 string is linear in i.
    """

    def cut(batches):
        for batch in batches:
            # One batch per sequence: a sequence has as many k-mers as letters.
            for row, sequence in enumerate(batch.column("sequence").to_pylist()):
                kmers = pa.array(list(kmer_set(sequence, k)), pa.string())
                owner = batch.column(key).take(pa.array(np.full(len(kmers), row)))
                yield pa.RecordBatch.from_arrays([owner, kmers], [key, "kmer"])

    schema = T.StructType([df.schema[key], T.StructField("kmer", T.StringType())])
    return df.select(key, "sequence").mapInArrow(cut, schema)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class KmerIndex:
    """Sorted k-mer hashes of a query set with the queries that hold each k-mer.

    Windows are compared by hash first and by their characters after, so counts are exact.
    """

    def __init__(self, sequences: list[str], k: int):
        self.k = k
        self.n_queries = len(sequences)
        texts = [code_points(s) for s in sequences]
        for seed in range(64):
            self._multiplier = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
            if self._build(texts):
                return
        raise RuntimeError("no collision-free hash found for the query k-mers")

    def _windows(self, codes: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(codes, self.k)

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes) - self.k + 1
        wide = codes.astype(np.uint64)
        h = wide[:n].copy()
        for i in range(1, self.k):
            h *= self._multiplier
            h += wide[i : i + n]
        h *= self._multiplier
        return h

    def _build(self, texts) -> bool:
        hashes, owners, windows = [], [], []
        for q, codes in enumerate(texts):
            if len(codes) < self.k:
                continue
            h, first = np.unique(self._hash(codes), return_index=True)
            whole = np.unique(self._windows(codes), axis=0)
            if len(whole) != len(h):
                return False
            hashes.append(h)
            owners.append(np.full(len(h), q, dtype=np.int32))
            windows.append(self._windows(codes)[first])
        if not hashes:
            self.hashes = np.empty(0, dtype=np.uint64)
            return True
        h, q, w = np.concatenate(hashes), np.concatenate(owners), np.concatenate(windows)
        order = np.argsort(h, kind="stable")
        h, self.owners, w = h[order], q[order], w[order]
        self.hashes, starts = np.unique(h, return_index=True)
        self.starts = np.r_[starts, len(h)]
        self.kmers = w[starts]
        self._seen = np.zeros(1 << SEEN_BITS, dtype=bool)
        self._seen[self.hashes >> SEEN_SHIFT] = True
        # Equal hashes across queries must be equal k-mers too.
        return bool((w == np.repeat(self.kmers, np.diff(self.starts), axis=0)).all())

    def shared(self, sequence: str) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the queries that share k-mers with ``sequence``, and how many distinct ones."""
        codes = code_points(sequence)
        none = np.empty(0, dtype=np.int64)
        if len(codes) < self.k or len(self.hashes) == 0:
            return none, none
        h = self._hash(codes)
        at = np.flatnonzero(self._seen[h >> SEEN_SHIFT])
        slot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        equal = self.hashes[slot] == h[at]
        at, slot = at[equal], slot[equal]
        if len(at) == 0:
            return none, none
        same = (self._windows(codes)[at] == self.kmers[slot]).all(axis=1)
        found = np.unique(slot[same])
        sizes = self.starts[found + 1] - self.starts[found]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.unique(self.owners[np.repeat(self.starts[found], sizes) + within], return_counts=True)


def index_bytes(queries: DataFrame, k: int) -> int:
    """Upper bound of a query index in bytes."""
    kmers = F.sum(F.greatest(F.length("sequence") - (k - 1), F.lit(0)))
    return (queries.agg(kmers).first()[0] or 0) * (BYTES_PER_KMER + 4 * k)


def kmer_candidates(
    targets: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    min_shared: int = DEFAULT_MIN_SHARED,
    max_index_bytes: int = MAX_INDEX_BYTES,
    keep_sequence: bool = False,
) -> DataFrame:
    """``target_idx, query_idx, shared`` of all pairs that share ``min_shared`` distinct k-mers.

    ``targets`` has ``target_idx, sequence``, ``queries`` has ``query_idx, sequence``; keys
    may be of any type. ``keep_sequence`` adds the target's sequence.
    """
    if min_shared < 1:
        raise ValueError("min_shared must be at least 1")
    targets = targets.select("target_idx", "sequence").where("sequence is not null")
    queries = queries.select("query_idx", "sequence").where("sequence is not null")
    if index_bytes(queries, k) <= max_index_bytes:
        return _indexed_candidates(targets, queries, k, min_shared, keep_sequence)
    return _joined_candidates(targets, queries, k, min_shared, keep_sequence)


def _indexed_candidates(targets: DataFrame, queries: DataFrame, k: int, min_shared: int, keep_sequence: bool) -> DataFrame:
    table = queries.toArrow().combine_chunks()
    index = KmerIndex(table.column("sequence").to_pylist(), k)
    keys = table.column("query_idx").combine_chunks()
    shared = targets.sparkSession.sparkContext.broadcast((index, keys))
    names = ["target_idx", "query_idx", "shared"] + ["sequence"] * keep_sequence

    def search(batches):
        index, keys = shared.value

        def pairs(batch, rows, found, counts):
            rows = pa.array(np.concatenate(rows))
            arrays = [batch.column("target_idx").take(rows), keys.take(pa.array(np.concatenate(found)))]
            arrays.append(pa.array(np.concatenate(counts), pa.int64()))
            if keep_sequence:
                arrays.append(batch.column("sequence").take(rows))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in (whole.slice(a, ROWS_AT_ONCE) for whole in batches for a in range(0, whole.num_rows, ROWS_AT_ONCE)):
            rows, found, counts, size = [], [], [], 0
            for row, sequence in enumerate(batch.column("sequence").to_pylist()):
                queries, shared_kmers = index.shared(sequence)
                enough = shared_kmers >= min_shared
                n = int(enough.sum())
                if n == 0:
                    continue
                rows.append(np.full(n, row))
                found.append(queries[enough])
                counts.append(shared_kmers[enough])
                size += n * (len(sequence) if keep_sequence else 1)
                if size > CHARACTERS_PER_BATCH:
                    yield pairs(batch, rows, found, counts)
                    rows, found, counts, size = [], [], [], 0
            if rows:
                yield pairs(batch, rows, found, counts)

    return targets.mapInArrow(search, _pairs_schema(targets, queries, keep_sequence))


def _rarest(kmers: DataFrame, key: str, frequency: DataFrame, min_shared: int) -> DataFrame:
    """All k-mers of each record but its ``min_shared - 1`` most frequent ones."""
    if min_shared == 1:
        return kmers
    ranked = salted_join(kmers, frequency, "kmer", spread=F.col(key), salts=4).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("n", "kmer"))).alias("ordered")
    )
    kept = F.slice("ordered", F.lit(1), F.greatest(F.size("ordered") - (min_shared - 1), F.lit(0)))
    return ranked.select(key, F.explode(F.transform(kept, lambda x: x["kmer"])).alias("kmer"))


def _joined_candidates(targets: DataFrame, queries: DataFrame, k: int, min_shared: int, keep_sequence: bool) -> DataFrame:
    t = targets.where(F.length("sequence") >= k)
    q = queries.where(F.length("sequence") >= k)
    t_kmers = explode_kmers(t, "target_idx", k)
    q_kmers = explode_kmers(q, "query_idx", k)
    # K-mers that no query holds can't be shared: they go before anything of the targets is shuffled twice.
    t_kmers = salted_join(t_kmers, q_kmers.select("kmer").distinct(), "kmer", "left_semi", spread=F.col("target_idx"))
    # One order for both sides: by number of records that hold the k-mer, then by the k-mer.
    held = t_kmers.select("kmer").unionByName(q_kmers.select("kmer"))
    frequency = held.groupBy("kmer").agg(F.count("*").alias("n"))
    seeds_t = _rarest(t_kmers, "target_idx", frequency, min_shared)
    seeds_q = _rarest(q_kmers, "query_idx", frequency, min_shared)
    pairs = salted_join(seeds_t, seeds_q, "kmer", spread=F.col("target_idx")).select("target_idx", "query_idx").distinct()
    # A target is in at most as many pairs as there are queries; a query may be in most pairs.
    with_target = pairs.join(t.withColumnRenamed("sequence", "_t"), "target_idx")
    both = salted_join(with_target, q.withColumnRenamed("sequence", "_q"), "query_idx", spread=F.col("target_idx"))

    def count(batches):
        for batch in batches:
            texts = zip(batch.column("_t").to_pylist(), batch.column("_q").to_pylist())
            shared = np.array([len(kmer_set(a, k) & kmer_set(b, k)) for a, b in texts], dtype=np.int64)
            arrays = [batch.column("target_idx"), batch.column("query_idx"), pa.array(shared)]
            arrays += [batch.column("_t")] * keep_sequence
            counted = pa.RecordBatch.from_arrays(arrays, names)
            yield counted.filter(pa.array(shared >= min_shared))

    names = ["target_idx", "query_idx", "shared"] + ["sequence"] * keep_sequence
    schema = _pairs_schema(targets, queries, keep_sequence)
    return both.select("target_idx", "query_idx", "_t", "_q").mapInArrow(count, schema)


def self_candidates(
    queries: DataFrame,
    k: int = DEFAULT_K,
    min_shared: int = DEFAULT_MIN_SHARED,
    max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """Pairs ``a_idx < b_idx`` of one sequence set that share ``min_shared`` distinct k-mers."""
    targets = queries.select(F.col("query_idx").alias("target_idx"), "sequence")
    pairs = kmer_candidates(targets, queries, k, min_shared, max_index_bytes)
    ordered = pairs.where("target_idx < query_idx")
    return ordered.select(F.col("target_idx").alias("a_idx"), F.col("query_idx").alias("b_idx"), "shared")


def distinct_sequences(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Split exact copies off: ``(text_id, sequence)`` once per sequence, ``(text_id, key)`` per row.

    Copies are found by a fixed-width identity of the text, with partial aggregation, so
    many copies of one sequence never meet in one task.
    """
    keyed = df.select(key, "sequence", text_key("sequence").alias("text_id"))
    return keyed.select("text_id", "sequence").dropDuplicates(["text_id"]), keyed.select("text_id", key)
