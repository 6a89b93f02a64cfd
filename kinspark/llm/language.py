"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinspark.llm.text import code_points, hash_share, slices, texts
from kinspark.session import through_table

UNDETERMINED = "und"
DIMENSIONS = 1 << 13
GRAMS = (1, 2, 3, 4)
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 500
SHARPNESS = 30.0
REJECT_MARGIN = 0.15
MAX_BROADCAST_ROWS = 200_000
_ROUNDS = 8
_STEP_ROWS = 128


@dataclass(frozen=True)
class LanguageModel:
    """Unit centroids with their language, inverse document frequencies, and the largest distance by text length."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray


def _counts(rows: list[str]) -> np.ndarray:
    """n-gram counts by hash bucket; a run of anything but letters counts as one space."""
    points, row = code_points(rows)
    letter = ((points >= 97) & (points <= 122)) | (points >= 0xAA)
    plain = np.where(letter, points, np.where(points == 0, 0, 32)).astype(np.uint32)
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | ((plain[:-1] != 32) & (plain[:-1] != 0))
    plain, row = plain[keep], row[keep]
    edge = np.concatenate(([0], np.cumsum(plain == 0)))
    counts = np.zeros(len(rows) * DIMENSIONS, np.float32)
    h = np.zeros(len(plain), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        m = len(plain) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + plain[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            inside = edge[n:] == edge[:m]
            x = h[inside]
            bucket = ((x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
            place = row[:m][inside] * DIMENSIONS + bucket
            counts += np.bincount(place, minlength=len(counts)).astype(np.float32)
    return counts.reshape(len(rows), DIMENSIONS)


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.maximum(norm, 1e-12)[:, None].astype(np.float32)


def _size_class(counts: np.ndarray) -> np.ndarray:
    """Texts of like length share a distance limit; short ones lie far from any centroid."""
    return np.log2(counts.sum(axis=1) + 1).astype(np.int64).clip(0, 31)


def _steps(column: pa.Array) -> Iterator[tuple[int, int]]:
    for a, b in slices(column):
        for c in range(a, b, _STEP_ROWS):
            yield c, min(b, c + _STEP_ROWS)


def _clusters(vectors: np.ndarray, k: int, rounds: int = _ROUNDS) -> np.ndarray:
    """Spherical k-means; starts from the mean and then the vectors farthest from all centroids so far."""
    mean = vectors.mean(axis=0)
    centroids = (mean / max(np.linalg.norm(mean), 1e-12))[None, :]
    while len(centroids) < min(k, len(vectors)):
        nearest = (vectors @ centroids.T).max(axis=1)
        centroids = np.vstack([centroids, vectors[int(np.argmin(nearest))]])
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.vstack([vectors[own == j].sum(axis=0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids.astype(np.float32)


def train(
    docs: DataFrame,
    may_learn: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
    centroids: int = CENTROIDS,
) -> LanguageModel:
    """Learn from the text and non-null language of rows for which ``may_learn`` is true.

    Document frequencies count all those rows. The centroids are fitted on ``per_language``
    rows of each language at most, those with the smallest hash of the key: the documented
    bound of the sample. Each language is fitted in a task of its own, and only centroids and
    limits reach the driver (32 KB each). Rows without a letter are not learnt from.
    """
    spark = docs.sparkSession
    rows = docs.where(may_learn & F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    rows = rows.select(F.col(key).alias("id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            column = texts(batch.column(0))
            for a, b in _steps(column):
                total += (_counts(column.slice(a, b - a).to_pylist()) > 0).sum(axis=0)
                n += b - a
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "c"])

    parts = rows.select("t").mapInArrow(frequencies, "n long, c array<long>")
    parts = parts.select("n", F.posexplode("c").alias("at", "c")).where("c > 0 or at = 0")
    sums = parts.groupBy("at").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).toPandas()
    counted = np.zeros(DIMENSIONS)
    counted[sums["at"].to_numpy(np.int64)] = sums["c"].to_numpy(float)
    n_rows = float(sums.loc[sums["at"] == 0, "n"].sum()) if len(sums) else 0.0
    idf = np.log((1 + n_rows) / (1 + counted)).astype(np.float32) + np.float32(1)

    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}  # one row per language
    order = W.partitionBy("l").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id")
    chosen = rows.select("id", "l").where(hash_share("id", "l", sizes, per_language)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    # At most ``per_language`` keys of each language; their texts are picked out in one scan.
    chosen = through_table(chosen.select("id", "l", "_n"), "language-sample")
    few = chosen.count() <= MAX_BROADCAST_ROWS
    sample = rows.join(F.broadcast(chosen) if few else chosen, ["id", "l"]).select("l", "t", "_n")
    spark_idf = spark.sparkContext.broadcast(idf)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_n", "t"])
        rows, idf = group["t"].tolist(), spark_idf.value
        counts = [_counts(rows[k : k + _STEP_ROWS]) for k in range(0, len(rows), _STEP_ROWS)]
        vectors = np.vstack([_unit(c, idf) for c in counts])
        sizes = np.concatenate([_size_class(c) for c in counts])
        found = _clusters(vectors, centroids)
        limits = np.full(32, -1.0)
        np.maximum.at(limits, sizes, 1 - (vectors @ found.T).max(axis=1))
        return pd.DataFrame({"l": group["l"].iloc[0], "v": [found.tobytes()], "limits": [limits.tolist()]})

    fitted = sample.groupBy("l").applyInPandas(fit, "l string, v binary, limits array<double>").orderBy("l").collect()
    matrix, languages, limits = [], [], np.full(32, -1.0)
    for r in fitted:
        own = np.frombuffer(bytes(r["v"]), np.float32).reshape(-1, DIMENSIONS)
        matrix.append(own)
        languages += [r["l"]] * len(own)
        limits = np.maximum(limits, np.array(r["limits"]))
    # Longer texts lie nearer; a class that the sample lacks takes the limit of the next shorter one.
    for k in range(32):
        if limits[k] < 0:
            limits[k] = limits[k - 1] if k else 1.0
    limits = np.maximum.accumulate(limits[::-1])[::-1]
    return LanguageModel(idf, np.vstack(matrix) if matrix else np.zeros((0, DIMENSIONS), np.float32), languages, limits)


def identify(
    docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, margin: float = REJECT_MARGIN
) -> DataFrame:
    """The nearest centroid's language for every whole text.

    Returns the key, the columns ``keep``, ``lang_pred``, ``score`` (0 to 1: the softmax share
    of the language among the cosines), ``distance`` (1 - cosine) and ``rejected``. A text is
    rejected if it is farther from every centroid than any training text of like length by
    more than ``margin``. Null texts, and texts without a letter, are ``und`` with score 0 and
    rejected; so is everything if the model has learnt no language. Equal texts get equal
    results; an empty table gives an empty one; other columns are not read.
    """
    keep = [c for c in keep or [] if c not in (key, text)]
    out = [key, *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out)
    schema += ", _lang_pred string, _score double, _distance double, _rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = sorted(set(m.languages))
        member = np.array([names.index(x) for x in m.languages], np.int64)
        for batch in batches:
            column = texts(batch.column(0))
            langs, scores, distances, rejected = [], [], [], []
            for a, b in _steps(column):
                rows = column.slice(a, b - a).to_pylist()
                has_letter = np.array([any(map(str.isalpha, x)) for x in rows], bool)
                if not names:
                    has_letter[:] = False
                counts = _counts(rows)
                cosines = _unit(counts, m.idf) @ m.centroids.T if names else np.zeros((len(rows), 1))
                best = np.full((len(rows), max(1, len(names))), -1.0)
                for j, k in enumerate(member):
                    best[:, k] = np.maximum(best[:, k], cosines[:, j])
                top = best.argmax(axis=1)
                high = best[np.arange(len(rows)), top].clip(-1, 1)
                share = 1 / np.exp(SHARPNESS * (best - high[:, None])).sum(axis=1)
                far = 1 - high > m.limits[_size_class(counts)] + margin
                langs += [names[t] if ok else UNDETERMINED for t, ok in zip(top, has_letter)]
                scores += np.where(has_letter, share.clip(0, 1), 0.0).tolist()
                distances += np.where(has_letter, 1 - high, 1.0).tolist()
                rejected += (far | ~has_letter).tolist()
            arrays = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(distances, pa.float64()), pa.array(rejected, pa.bool_())]
            own = [batch.column(k) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, *arrays], [*out, "_lang_pred", "_score", "_distance", "_rejected"])

    renamed = {"_lang_pred": "lang_pred", "_score": "score", "_distance": "distance", "_rejected": "rejected"}
    found = docs.select(F.col(text).alias("_t"), *out).mapInArrow(predict, schema)
    return found.withColumnsRenamed(renamed)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Rows whose language is identified, with all their columns; rejected ones go."""
    names = docs.columns
    spare = docs.select(F.col(text).alias("_t"), F.struct(*names).alias("_row"))
    found = identify(spare, model, key="_row", text="_t")
    return found.where(~F.col("rejected")).select(*(F.col("_row").getField(c).alias(c) for c in names))
