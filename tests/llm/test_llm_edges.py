"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinspark.llm import fingerprint, jaccard, language, licenses, mixing, packing, pages, quality, records, toxicity
from kinspark.llm.text import held_out
from kinspark.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected boolean, id long, token string, _row int, copy_number int"
LONG = "long words without end " * 4000
ROWS = [
    (1, "the cat sat on the mat and looked at the dog", "en"),
    (1, "the cat sat on the mat and looked at the dog", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\n ", "de"),
    (5, LONG, "en"),
    (6, "der hund und die katze sitzen auf der matte und schlafen", "de"),
    (7, "\U0001f600 éß <|endoftext|> \x1c x", "fr"),
    (None, "no key at all but some words here", None),
    (8, "word", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, None if k % 3 else "web", None, None, None, 5, "t", 1, 9) for k, (i, t, lang) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (5, None, 0), (6, 0, 0), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")


def ids(df, key="doc_id"):
    return sorted((r[key] for r in df.collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_toxicity(docs, labels):
    model = toxicity.train(docs, labels, ~held_out())
    found = toxicity.score(docs, model)
    assert ids(found) == ALL
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.collect())
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    empty = toxicity.train(docs.limit(0), labels.limit(0), ~held_out())
    assert {r["predicted"] for r in toxicity.score(docs, empty).collect()} == {0}


def test_language(docs):
    model = language.train(docs, F.lit(True))
    found = {(r["doc_id"], r["lang_pred"]) for r in language.identify(docs, model, keep=["score"]).select("doc_id", "lang_pred").collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= found
    assert {(1, "en"), (5, "en"), (6, "de")} <= found
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {2, 3, 4} & set(ids(kept))
    nothing = language.train(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_fingerprint(docs):
    found = fingerprint.compare_with_edit(docs).collect()
    assert sorted((r["doc_id"] for r in found), key=lambda x: (x is None, x)) == ALL
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (2, 3)}) == 1
    assert len({r["fingerprint"] for r in found if r["doc_id"] == 1}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert fingerprint.compare_with_edit(docs.limit(0)).count() == 0


def test_packing(docs):
    found = packing.pack_documents(docs).collect()
    assert sum(r["length"] for r in found if r["doc_id"] in (2, 3, 4)) == 3
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_jaccard(docs):
    found = [(r["id"], r["n_shingles"], r["component"]) for r in jaccard.jaccard_groups(docs).members.collect()]
    assert sorted(f for f in found if f[0] in (1, 2, 3, 4, 8)) == [(1, 7, 1), (1, 7, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (8, 1, 8)]
    assert [f[2] for f in found if f[0] is None] == [None]
    assert jaccard.jaccard_groups(docs.limit(0)).members.count() == 0
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns and ids(kept) == [1, 2, 3, 4, 5, 6, 7, 8, None]


def test_mixing(docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == [c for c in docs.columns if c != "copy_number"] + ["copy_number", "mix_order"]
    assert mixing.mix(docs, numbered=False).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, weights={}).where("text <> ''").count() == 0


def test_records(spark, docs):
    path = scratch_path(spark, "records")
    found = records.read_records(spark, path, records.write_records(docs, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, *ALL[:-1]]
    assert [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:k]) for k in range(len(found))]
    path = scratch_path(spark, "records")
    assert records.read_records(spark, path, records.write_records(docs.limit(0), path)).count() == 0


def test_pages(spark):
    rows = [(1, "u", None, "x", 3), (2, None, "", "x", 3), (3, "u", "<p>one<p>two &amp; three", "x", 3), (None, "u", "<div><<<>", "x", 3), (3, "u", "<p>one<p>two &amp; three", "x", 3)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in pages.extract_text(table, keep=["url", "text"]).collect())
    assert found[:4] == [("1", "", 0), ("2", "", 0), ("3", "one\ntwo & three", 15), ("3", "one\ntwo & three", 15)]
    assert pages.extract_text(table.limit(0)).count() == 0


def test_quality(docs):
    found = quality.judge(docs)
    assert ids(found) == ALL
    assert all(r["base_failed"] and not r["kept"] for r in found.where("doc_id in (2, 3, 4, 8)").collect())
    assert quality.judge(docs.limit(0)).count() == 0


def test_licenses(docs):
    found = licenses.scan(docs)
    assert ids(found) == ALL
    assert {(r["n_words"], r["labels"], r["first_word"]) for r in found.where("doc_id in (2, 3, 4)").collect()} == {(0, "", None)}
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, sf_dir, name, stage):
    for table in (docs, docs.limit(0)):
        found = stage(spark, table, sf_dir)
        if name != "packing":
            assert found.columns == docs.columns
        found.count()
