"""Classifiers on held-out rows of the given tables, and against plain ones."""

import math
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinspark.llm import language, toxicity
from kinspark.llm.text import held_out

TABLES = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect()
    import zlib

    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = language.train(docs, ~held_out())
    found = language.identify(docs, model, keep=["lang"]).where(held_out())
    right, kept, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg((~F.col("rejected")).cast("int")), F.count("*")).first()
    assert n > 2000 and right > 0.99 and kept > 0.995
    strange = spark.createDataFrame([(1, "日本語の文章はここにあります" * 20), (2, "12 34 !!"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: (r["rejected"], r["lang_pred"] == "und") for r in language.identify(strange, model).collect()} == {1: (True, False), 2: (True, True), 3: (True, True)}


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, ~held_out())
    scored = toxicity.score(docs, model).where(held_out()).join(labels, "doc_id")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    hits, missed, wrong = counts.get((1, 1), 0), counts.get((1, 0), 0), counts.get((0, 1), 0)
    assert hits / (hits + missed) > 0.8 and hits / (hits + wrong) > 0.9


def test_labels_of_held_out_documents_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    changed = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, table, ~held_out()) for table in (labels, changed))
    assert a.intercept == b.intercept and (a.weights == b.weights).all()
    shuffled = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert language.train(docs, ~held_out()).languages == language.train(shuffled, ~held_out()).languages


def test_toxicity_keeps_ngrams_of_small_ratio(spark):
    # "zebra" is in 60 % of the toxic and 40 % of the other texts: a log-ratio of 0.4, at five standard errors.
    rows = [(k, "zebra" if k // 2 % 10 < (6 if k % 2 else 4) else "horse", k % 2) for k in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table, table, F.lit(True))
    scores = {r["text"]: r["score"] for r in toxicity.score(table, model).join(table.select("doc_id", "text"), "doc_id").collect()}
    assert scores["zebra"] > 0.52 > 0.48 > scores["horse"]
    assert toxicity.SAMPLE_PER_LABEL == 8000


def test_toxicity_fit_does_not_depend_on_chunks():
    rng = np.random.default_rng(3)
    lengths, ratios = rng.integers(0, 9, 60), rng.normal(size=40)
    features = np.concatenate([rng.choice(40, n, replace=False) for n in lengths]).astype(np.int32)
    labels = rng.integers(0, 2, 60).astype(float)
    ends = np.cumsum(lengths)
    whole = toxicity._fit([(lengths, features)], ratios, labels)
    parts = toxicity._fit([(lengths[:25], features[: ends[24]]), (lengths[25:], features[ends[24] :])], ratios, labels)
    assert np.allclose(whole[0], parts[0]) and np.isclose(whole[1], parts[1])


# --- the toxicity classifier against a plain one ----------------------------------------------------


def grams(text):
    """Distinct hashed n-grams, one after the other."""
    plain = " ".join(["", *"".join(c if "a" <= c <= "z" or c >= "\xaa" else " " for c in text.lower()).split(" ")])
    while "  " in plain:
        plain = plain.replace("  ", " ")
    found = set()
    for n in toxicity.GRAMS:
        for i in range(len(plain) - n + 1):
            h = 0
            for k, c in enumerate(plain[i : i + n], 1):
                h = (h * 0x01000193 + ord(c) + k) & 0xFFFFFFFF
            found.add((((h ^ (h >> 15)) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return found


def test_features_of_short_and_long_texts(monkeypatch):
    rng = random.Random(4)
    rows = ["", "a", "ab c", "x  y!!", "\u03a3\u03b1\u03a3 \u00e9t\u00e9", " lead", "trail "] + ["".join(rng.choice("abc  ,.\u00e9Z") for _ in range(n)) for n in (50, 700, 3000)]
    chosen = np.ones(1 << toxicity.BITS, bool)
    column = pa.array(rows, pa.large_string())
    for slice_bytes, slice_rows, piece in ((1 << 18, 4096, 1 << 17), (64, 4096, 40), (64, 1, 7), (1 << 18, 2, 1)):
        monkeypatch.setattr(toxicity, "_SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(toxicity, "_SLICE_ROWS", slice_rows)
        monkeypatch.setattr(toxicity, "_PIECE", piece)
        found = [set() for _ in rows]
        for a, _, row, bucket in toxicity._distinct(column, chosen):
            assert len(set(zip(row.tolist(), bucket.tolist()))) == len(row)
            for r, b in zip(row.tolist(), bucket.tolist()):
                found[a + r].add(b)
        assert found == [grams(t) for t in rows]


def test_scores_are_sums_of_the_ratios_times_weights(spark):
    """Log-count ratios, their selection and the linear score, recomputed with dictionaries."""
    rng = random.Random(9)
    mild, harsh = [f"w{k}" for k in range(60)], [f"vile{k}" for k in range(10)]
    rows = [(k, " ".join(rng.choice(mild + harsh * (k % 2) * 3) for _ in range(30)), k % 2) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table, table, F.lit(True))
    sets, n = [grams(t) for _, t, _ in rows], [200, 200]
    counts = [Counter(g for s, (_, _, y) in zip(sets, rows) if y == v for g in s) for v in (0, 1)]
    ratios = {}
    for g in counts[0] | counts[1]:
        p = [(counts[v][g] + toxicity.SMOOTHING) / (n[v] + 2 * toxicity.SMOOTHING) for v in (0, 1)]
        if abs(p[1] - p[0]) / sum(q * (1 - q) / m for q, m in zip(p, n)) ** 0.5 >= toxicity.LEAST_Z:
            ratios[g] = math.log(p[1] / p[0])
    assert set(np.flatnonzero(model.weights).tolist()) <= set(ratios)
    # The trained weights are ratio times coefficient: a plain descent on the same loss does not get lower.
    x = np.array([[ratios[g] * (g in s) for g in sorted(ratios)] for s in sets])
    y = np.array([v for _, _, v in rows], float)
    w = np.array([model.weights[g] / ratios[g] for g in sorted(ratios)], float)

    def loss(w, b):
        z = x @ w + b
        return float(np.mean(np.logaddexp(0, z) - y * z)) + toxicity._SHRINK / 2 * float(w @ w)

    plain, b = np.full(x.shape[1], 0.05), -1.0
    for _ in range(2000):
        e = 1 / (1 + np.exp(-(x @ plain + b))) - y
        plain, b = plain - 0.002 * (x.T @ e / len(y) + toxicity._SHRINK * plain), b - 0.002 * e.mean()
    assert loss(w, model.intercept) <= loss(plain, b)
    for r in toxicity.score(table, model).collect():
        z = sum(float(model.weights[g]) for g in sets[r["doc_id"]]) + model.intercept
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_work_arrays_stay_small():
    """In a process of its own: a megabyte of texts, then one text of ten megabytes."""
    code = """
import resource, random, numpy as np, pyarrow as pa
from kinspark.llm import toxicity
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
rng = random.Random(0)
words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(50000)]
big = " ".join(rng.choice(words) for _ in range(200000))[: 1 << 20]
chosen = np.ones(1 << 20, bool)
def use(rows):
    before = peak()
    for _ in toxicity._distinct(pa.array(rows, pa.large_string()), chosen):
        pass
    return peak() - before
print(use([big[i : i + 4000] for i in range(0, 1 << 20, 4000)]), use([big * 10]))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    texts, long = map(float, out.stdout.split())
    assert texts < 100 and long < 150
