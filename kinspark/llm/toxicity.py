"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinspark.llm.text import code_points, hash_share, slices, texts
from kinspark.session import through_table

BITS = 20
GRAMS = (3, 4, 5, 6)
THRESHOLD = 0.3
SAMPLE_PER_LABEL = 8000
SMOOTHING = 0.5
LEAST_Z = 3.5
_STEPS, _RATE, _SHRINK = 200, 0.05, 3e-5
_SAMPLE_TASKS = 8
# Features of the sample that a step of the fit takes at once.
_CHUNK_FEATURES = 1 << 20
# Bytes and rows (32 bits hold a row and a bucket) that are worked on at once, and characters of a long text.
_SLICE_BYTES, _SLICE_ROWS, _PIECE = 256 * 1024, 1 << (32 - BITS), 128 * 1024


@dataclass(frozen=True)
class ToxicityModel:
    """Weight of every n-gram bucket (already times its log-count ratio; zero where not selected), and the intercept."""

    weights: np.ndarray
    intercept: float


def _plain(points: np.ndarray) -> np.ndarray:
    """Code points with a space for anything but letters."""
    letter = ((points >= 97) & (points <= 122)) | (points >= 0xAA)
    return np.where(letter, points, np.uint32(32)).astype(np.uint32)


def _buckets(plain: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the buckets of the n-grams from every point on."""
    h = np.zeros(len(plain), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        m = len(plain) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193) + plain[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            yield n, ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _of_slice(rows: list[str], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of at most ``_SLICE_ROWS`` short texts; a run of anything but letters is one space."""
    points, row = code_points(rows)
    edge = points == 0
    # Every text begins with a space, so a word's start looks the same everywhere.
    plain = _plain(points)
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32) | edge[1:]
    plain, row, edge = plain[keep], row[keep].astype(np.uint32), edge[keep]
    edges = np.concatenate(([0], np.cumsum(edge, dtype=np.int32)))
    pairs = np.zeros(0, np.uint32)
    for n, bucket in _buckets(plain):
        m = len(bucket)
        inside = edges[n - 1 : n - 1 + m] == edges[1 : m + 1]  # no separator after the first point
        inside &= ~edge[n - 1 :]
        inside &= chosen[bucket]
        pairs = np.concatenate((pairs, np.unique((row[:m][inside] << np.uint32(BITS)) | bucket[inside])))
    pairs = np.unique(pairs)
    return (pairs >> np.uint32(BITS)).astype(np.int64), (pairs & np.uint32((1 << BITS) - 1)).astype(np.int64)


def _of_long(text: str, chosen: np.ndarray) -> np.ndarray:
    """Distinct buckets of one long text, a piece at a time; pieces overlap by all but one point of the longest n-gram."""
    text = text.replace("\0", " ").lower()
    seen = np.zeros(1 << BITS, bool)
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), _PIECE):
        piece = text[at : at + _PIECE]
        plain = np.concatenate((tail, _plain(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4"))))
        keep = np.ones(len(plain), bool)
        keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
        plain = plain[keep]
        for _, bucket in _buckets(plain):
            seen[bucket] = True
        tail = plain[-(max(GRAMS) - 1) :]
    return np.flatnonzero(seen & chosen)


def _distinct(column: pa.Array, chosen: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Range of rows, then distinct (row, bucket) pairs among the ``chosen`` buckets, rows from the range's first on.

    Work arrays follow ``_SLICE_BYTES``, not the text: a long text is cut into pieces, of which only a table of buckets stays.
    """
    for a, b in slices(column, _SLICE_BYTES):
        for at in range(a, b, _SLICE_ROWS):
            end = min(at + _SLICE_ROWS, b)
            rows = column.slice(at, end - at).to_pylist()
            if len(rows) == 1 and len(rows[0]) > _PIECE:
                bucket = _of_long(rows[0], chosen)
                yield at, end, np.zeros(len(bucket), np.int64), bucket
            else:
                yield at, end, *_of_slice(rows, chosen)


def _merged(chunks: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Neighbouring chunks in one, up to ``_CHUNK_FEATURES`` features: every chunk costs a pass over all weights a step."""
    merged, own, size = [], [], 0
    for lengths, features in chunks:
        if own and size + len(features) > _CHUNK_FEATURES:
            merged.append(tuple(np.concatenate(x) for x in zip(*own)))
            own, size = [], 0
        own.append((lengths, features))
        size += len(features)
    return [*merged, tuple(np.concatenate(x) for x in zip(*own))] if own else merged


def _fit(chunks: list[tuple[np.ndarray, np.ndarray]], ratios: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times ratio, by gradient steps with momentum.

    A chunk has the number of features of each of its texts, and those features one after the
    other; the labels are of all texts. Nothing else of the size of the features is held.
    """
    n, size = len(labels), len(ratios)
    w, b = np.full(size, 0.05), -1.0
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, _STEPS + 1):
        weights, sums, slope, at = w * ratios, np.zeros(size), 0.0, 0
        for lengths, features in chunks:
            own = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            z = np.bincount(own, weights[features], len(lengths)) + b
            error = 1 / (1 + np.exp(-z.clip(-40, 40))) - labels[at : at + len(lengths)]
            sums += np.bincount(features, error[own], size)
            slope, at = slope + error.sum(), at + len(lengths)
        grad = np.append(sums * ratios / n + _SHRINK * w, slope / n)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        move = _RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w * ratios, float(b)


def train(
    docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL
) -> ToxicityModel:
    """Fit on labelled rows for which ``may_learn`` (over the key) is true.

    The fit uses ``per_label`` texts of each label at most, those whose keys have the smallest
    hash: the documented bound of the sample; the intercept is set for the shares of the labels
    among all rows that may be learnt from. Each n-gram's ratio compares the (smoothed) shares
    of toxic and other texts that hold it; n-grams whose shares differ by ``LEAST_Z`` standard
    errors are kept. One task fits the weights of the sample; the driver holds counts and weights
    of the buckets only. Conflicting labels of one key count as toxic. Null labels are left out.
    Without texts of both labels the score is the share of toxic ones.
    """
    known = labels.where(may_learn & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = through_table(known.where("y in (0, 1)"), "labels")
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = W.partitionBy("y").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id")
    ids = known.where(hash_share("id", "y", shares, per_label)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label).select("id", "y")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(ids), "id").select("y", "t")
    rows = through_table(rows.repartition(_SAMPLE_TASKS, F.xxhash64("t")), "toxicity-sample")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros((2, 1 << BITS), np.uint32), [0, 0]
        everything = np.ones(1 << BITS, bool)
        for batch in batches:
            column, y = texts(batch.column(1)), batch.column(0).to_numpy()
            for a, b, row, bucket in _distinct(column, everything):
                for v in (0, 1):
                    own = y[a:b] == v
                    np.add.at(counts[v], bucket[own[row]], np.uint32(1))
                    sizes[v] += int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (sizes[0], sizes[1], counts[0].tobytes(), counts[1].tobytes())], ["n0", "n1", "c0", "c1"])

    counts, sizes = np.zeros((2, 1 << BITS)), np.zeros(2)
    # Written first: all tasks at once, and then one task's counts at a time on the driver.
    parts = through_table(rows.mapInArrow(presence, "n0 long, n1 long, c0 binary, c1 binary"), "ngram-counts")
    for r in parts.toLocalIterator():
        for v in (0, 1):
            counts[v] += np.frombuffer(bytes(r[f"c{v}"]), np.uint32)
            sizes[v] += r[f"n{v}"]
    if not sizes.all():
        share = min(max((shares.get(1, 0) + 1e-3) / (sum(shares.values()) + 2e-3), 1e-6), 1 - 1e-6) if shares else 0.0
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))) if shares else -20.0)
    rate = (counts + SMOOTHING) / (sizes[:, None] + 2 * SMOOTHING)
    z = (rate[1] - rate[0]) / np.sqrt((rate * (1 - rate) / sizes[:, None]).sum(axis=0))
    buckets = np.flatnonzero(np.abs(z) >= LEAST_Z)
    ratios = np.log(rate[1, buckets] / rate[0, buckets])
    del counts, rate, z
    place = np.full(1 << BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    shared = docs.sparkSession.sparkContext.broadcast((place, ratios))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, _ = shared.value
        for batch in batches:
            column = texts(batch.column(1))
            for a, b, row, bucket in _distinct(column, at >= 0):
                lengths = np.bincount(row, minlength=b - a).astype(np.int32)
                values = [batch.column(0).slice(a, b - a).to_numpy().astype(np.int8), lengths, at[bucket]]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in values], ["y", "lengths", "f"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, chunks = [], []
        for batch in batches:
            for y, lengths, f in zip(*(batch.column(k) for k in range(3))):
                labels.append(np.frombuffer(y.as_py(), np.int8))
                chunks.append((np.frombuffer(lengths.as_py(), np.int32), np.frombuffer(f.as_py(), np.int32)))
        if chunks:
            weights, b = _fit(_merged(chunks), shared.value[1], np.concatenate(labels).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([b])], ["w", "b"])

    # Written first, by all tasks at once; one task on an executor then holds the sample's features, four bytes each.
    found = through_table(rows.mapInArrow(present, "y binary, lengths binary, f binary"), "ngram-features")
    fit = through_table(found.coalesce(1).mapInArrow(fitted, "w binary, b double"), "toxicity-fit").first()
    weights, b = np.frombuffer(bytes(fit["w"])), fit["b"]
    b += float(np.log(shares[1] / sizes[1]) - np.log(shares[0] / sizes[0]))
    whole = np.zeros(1 << BITS, np.float32)
    whole[buckets] = weights
    return ToxicityModel(whole, b)


def text_score(text: str, docs: DataFrame, model: ToxicityModel) -> Column:
    """The score of a text column; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        chosen = m.weights != 0
        for batch in batches:
            values = np.zeros(len(batch))
            for a, b, row, bucket in _distinct(texts(batch), chosen):
                values[a:b] = np.bincount(row, m.weights[bucket], b - a)
            yield pa.array(1 / (1 + np.exp(-(values + m.intercept).clip(-40, 40))))

    return F.arrow_udf(scored, "double", F.ArrowUDFType.SCALAR_ITER)(F.col(text))


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns the key, ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) for every whole text.

    The score is that of the distinct n-grams of the text, wherever they stand and however
    long it is. Null and empty texts have the score of no n-grams. Equal texts have equal
    scores; other columns are not read; an empty table gives an empty one.
    """
    found = docs.select(key, text_score(text, docs, model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Rows that are not predicted toxic, with all their columns, of any names; a null or empty text has the score of no n-grams."""
    return docs.where(text_score(text, docs, model) < THRESHOLD)
