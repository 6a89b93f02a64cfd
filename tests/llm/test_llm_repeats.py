"""Removal of repeated passages against brute force."""

import random
import re

import numpy as np
import pytest

from kinspark.llm import repeats

WORD = re.compile("[^\x20\x09-\x0d]+")
LAST = 1 << 70


def cut(rows):
    """Kept words by a dictionary of all windows."""
    first = {}
    split = [(LAST if d is None else d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            window = tuple(w[i : i + 13])
            first[window] = min(first.get(window, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), "".join("x" if g else "." for g in gone)))
    return sorted(out)


def found(df, **how):
    out = []
    for r in repeats.drop_repeats(df, **how).collect():
        marks = ["."] * r["n_words"]
        for s in r["spans"]:
            marks[s["start"] : s["start"] + s["length"]] = ["x"] * s["length"]
        out.append((LAST if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"], "".join(marks)))
    return sorted(out)


def invented(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcde") for _ in range(rng.randint(5, 60))] for _ in range(30)]
    rows = []
    for d in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            words += b[a : a + rng.randint(1, 40)] + [rng.choice("ABCxyz")] * rng.randint(0, 3)
        rows.append((rng.choice([None, d, d, d]), rng.choice([" ", "\t\n "]).join(words)))
    return [*rows, (5, None), (6, ""), (7, "a b " * 50), (8, "a b " * 40), (9, "z " * 100), (10, "Z " * 30), (11, " \x1c \x85 ")]


@pytest.mark.parametrize("shard_bytes", [repeats.SHARD_BYTES, 200])
def test_repeats_by_brute_force(spark, shard_bytes, monkeypatch):
    monkeypatch.setattr(repeats, "FLUSH_ANCHORS", 50)
    rows = invented(shard_bytes)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, shard string")
    assert found(df, shard_bytes=shard_bytes) == cut(rows)
    assert repeats.drop_repeats(df.limit(0)).count() == 0


def test_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(df) == cut([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_a_passage_of_a_third_of_all_documents_and_a_long_text(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(d, f"own{d} {passage} end{d}" if d % 3 == 0 else f"other {d}") for d in range(300)]
    rows += [(1000, " ".join(f"w{k % 70_001}" for k in range(200_000))), (1001, " ".join(f"w{k}" for k in range(500, 520)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(df) == cut(rows)


def test_every_window_of_a_passage_holds_a_phrase():
    for length in range(13, 60):
        starts = np.arange(5, 5 + length - 12)
        phrases = set(repeats._phrases(starts, np.zeros(100, int)).tolist())
        assert all(phrases & set(range(s, s + 7)) for s in starts.tolist())
        assert all(5 <= p <= 5 + length - 7 for p in phrases)
