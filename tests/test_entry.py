"""Registered queries against their SQL, at the smallest scale."""

import glob
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as registry  # noqa: E402

duckdb = pytest.importorskip("duckdb")

# A few of every kind; the whole list is compared outside the tests, at a larger scale.
CHECKED = ["s02_zstd_frames_scan", "s04_half_vectors_scan", "s07_alignment_scan", "k01_diversified_hits", "k06_alignment_table", "a02_stage_counts", "j01_similarity_index", "j01_similarity_join", "j07_prefix_merge", "j10_spaced_groups", "w02_nearest_bounded", "j05_filter_aligned", "j07_expand_members_prefix", "j10_kmer_candidates", "m01_embed", "w02_nearest_per_shard"]


def normal(value):
    return f"{value:.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, database, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = database.execute(registry.oracle_sql()[name])
    place = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(tuple(normal(row[i]) for i in place) for row in result.fetchall())
    assert sorted(tuple(normal(row[c]) for c in columns) for row in df.collect()) == want


def test_registry_names_follow_the_inventory():
    names = registry.queries()
    assert set(registry.oracle_sql()) <= set(names)
    assert all(re.fullmatch(r"[skpjaowumft]\d\d_\w+|op\d+_\w+|pipeline", name) for name in names)


def test_entry(spark):
    assert registry.entry(spark).count() == 72


def test_reduced_search_compares_no_texts(spark, sf_dir, monkeypatch):
    """Each of its tables of hits has an identity for every text, not the text."""
    written, write = {}, registry.through_table

    def seen(df, name):
        written[name] = df.columns
        return write(df, name)

    monkeypatch.setattr(registry, "through_table", seen)
    found = {r.kind: r.n_wrong for r in registry.queries()["f02_search_reduced"](spark, sf_dir).collect()}
    assert found == {"extra": 0, "missing": 0, "none": 0}
    assert "sequence" not in written["reduced-hits"] + written["hits"] and "text_id" in written["hits"]
