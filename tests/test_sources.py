import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from conftest import rows
from kinspark.functions.validation import validation_report
from kinspark.plans import build
from kinspark.operators.embed import hashed_kmer_encoder
from kinspark.sources import fasta, stores, tables, vectors

MULTI = ">a one # 1 # 2 # -1 # extra # more\nMKV\nLLA*\n>b\nMMK \n\nPQR\n>c third\nWWW**\n"
RECORDS = [("a one # 1 # 2 # -1 # extra # more", "MKVLLA*"), ("b", "MMKPQR"), ("c third", "WWW**")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "multi.fa").write_text(MULTI)
    (tmp_path / "multi.fa.zst").write_bytes(zstandard.compress(MULTI.encode()))
    (tmp_path / "empty_seq.fa").write_text(">x\nMK\n>nothing\n>y\nLL\n")
    (tmp_path / "no_header.fa").write_text("MKV\n>x\nMK\n")
    return tmp_path


@pytest.mark.parametrize("name", ["multi.fa", "multi.fa.zst"])
def test_fasta_scan(spark, folder, name):
    assert rows(fasta.read_fasta(spark, str(folder / name))) == RECORDS


def test_fasta_glob_and_file_name(spark, folder):
    df = fasta.read_fasta(spark, str(folder), glob="multi*", with_file=True)
    assert rows(df.groupBy("file_name").count()) == [("multi.fa", 3), ("multi.fa.zst", 3)]


def test_fasta_jobs_split_files(spark, folder):
    parts = [fasta.read_fasta(spark, str(folder), jobs=3, job=i).count() for i in range(3)]
    # 3 + 3 + 2 records, and 1 after the record without a header, which has no sequence.
    assert sum(parts) == fasta.read_fasta(spark, str(folder)).count() == 9


def test_fasta_empty_sequence_goes_with_its_name(spark, folder):
    path = str(folder / "empty_seq.fa")
    assert rows(fasta.read_fasta(spark, path)) == [("x", "MK"), ("y", "LL")]
    assert rows(validation_report(fasta.read_fasta(spark, path, drop_empty=False))) == [("empty_sequence", 1)]


def test_headerless_file_is_found(spark, folder):
    assert [r.file_path.rsplit("/", 1)[1] for r in fasta.headerless_files(spark, str(folder)).collect()] == ["no_header.fa"]


def test_indexed_fasta_counts_over_files_in_order(spark, tmp_path):
    text = ["".join(f">f{f}_{i}\nMK{'A' * (i % 7)}\n" for i in range(200)) for f in range(3)]
    for f, body in enumerate(text):
        (tmp_path / f"part{f}.fa").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = rows(fasta.read_indexed_fasta(spark, str(tmp_path)).select("centroid_idx", "name"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(f * 200 + i, f"f{f}_{i}") for f in range(3) for i in range(200)]


def test_fp16_vectors(spark, tmp_path):
    values = np.random.default_rng(0).normal(size=(3, 512)).astype("<f2")
    (tmp_path / "v.f16").write_bytes(values.tobytes())
    got = vectors.read_fp16_vectors(spark, str(tmp_path / "v.f16")).orderBy("centroid_idx").collect()
    assert [r.centroid_idx for r in got] == [0, 1, 2]
    assert np.array_equal(np.array([r.embedding for r in got], dtype=np.float32), values.astype(np.float32))
    (tmp_path / "broken.f16").write_bytes(values.tobytes() + b"xx")
    with pytest.raises(ValueError, match="1024-byte rows"):
        vectors.read_fp16_vectors(spark, str(tmp_path / "broken.f16"))


def test_membership_splits_at_first_space(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("c1 p1\nc1 p2\n\nnospace\nc2 p3 extra\n")
    assert rows(tables.read_membership(spark, str(tmp_path / "dict.txt"))) == [("c1", "p1"), ("c1", "p2"), ("c2", "p3 extra")]


def test_hits_table(spark, tmp_path):
    (tmp_path / "hits.tsv").write_text('#query\tname\tseq\td\n\nq1\tn "1"\tMK\t0.1\nq2\tn2\tMK\t0.05\n')
    got = rows(tables.read_hits_tsv(spark, str(tmp_path / "hits.tsv")))
    assert got == [("q1", 'n "1"', "MK", 0.1), ("q2", "n2", "MK", 0.05)]


def test_hits_table_round_trip_is_ordered_and_has_one_header(spark, tmp_path):
    hits = spark.createDataFrame(
        [("q2", "b", "MK", 0.3), ("q1", "z", "MK", 0.2), ("q1", "a", "ML", 0.1)], list(tables.HIT_COLUMNS)
    )
    path = str(tmp_path / "out")
    tables.write_diversified_hits(hits, path)
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text == tables.HITS_HEADER + "\nq1\ta\tML\t0.1\nq1\tz\tMK\t0.2\nq2\tb\tMK\t0.3\n"
    assert rows(tables.read_hits_tsv(spark, path)) == rows(hits)


def test_alignment_table_round_trip(spark, tmp_path):
    row = ("t", "q", 0.924, 202, 15, 0, 1, 202, 1, 202, 4.604e-129, 393.0)
    df = spark.createDataFrame([row], tables.ALIGNMENT_SCHEMA)
    for header in (True, False):
        path = str(tmp_path / f"aln{header}")
        tables.write_alignments(df, path, header=header)
        assert rows(tables.read_alignments(spark, path)) == [row]
        assert spark.read.text(path).count() == 1 + header


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a x", "MK"), ("b", "LLL")], ["name", "sequence"])
    tables.write_fasta(df, "name", "sequence", str(tmp_path / "f"))
    assert rows(fasta.read_fasta(spark, str(tmp_path / "f"))) == rows(df)


def test_existing_output_is_refused_unless_forced(spark, tmp_path):
    df = spark.createDataFrame([("a", "MK")], ["name", "sequence"])
    path = str(tmp_path / "f")
    tables.write_fasta(df, "name", "sequence", path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        tables.write_fasta(df, "name", "sequence", path)
    tables.write_fasta(df, "name", "sequence", path, mode="overwrite")


def test_query_vectors_get_names_and_unit_length(spark, tmp_path):
    df = spark.createDataFrame([(0, None, [3.0, 4.0]), (1, "x", [1.0, 0.0])], "query_idx long, query_name string, embedding array<float>")
    path = str(tmp_path / "q")
    vectors.write_query_embeddings(df, path)
    got = {r.query_idx: r for r in vectors.load_query_embeddings(spark, path).collect()}
    assert got[0].query_name == "query_0" and got[1].query_name == "x"
    assert np.allclose(got[0].embedding, [0.6, 0.8])


def test_member_store_layout(spark, tmp_path):
    df = spark.createDataFrame([(f"c{i % 5}", f"c{i % 5}_m{i}", "MK") for i in range(50)], ["centroid_id", "member_header", "sequence"])
    path = str(tmp_path / "store")
    stores.write_member_store(df, path, buckets=4)
    back = stores.read_member_store(spark, path)
    assert rows(back.select(df.columns)) == rows(df)
    assert back.where("dir = 1").select("dir").distinct().count() <= 1
    assert "PartitionFilters: [isnotnull(dir" in back.where("dir = 1")._jdf.queryExecution().toString()


def test_member_store_job(spark, tmp_path):
    corpus = spark.createDataFrame(
        [("p1 # 1 # 2 # -1 # cut", "MK"), ("p2 # 3 # 4 # 1", "ML"), ("p9 # 3 # 4 # 1", "MW")], ["name", "sequence"]
    )
    membership = spark.createDataFrame([("c1", "p1"), ("c1", "p2"), ("c2", "p2"), ("c3", "p8")], ["centroid_id", "member_id"])
    store = build.build_member_store(corpus, membership, str(tmp_path / "db"), shards=4, buckets=4)
    assert rows(store.select("member_header", "sequence")) == [
        ("c1_p1 # 1 # 2 # -1", "MK"), ("c1_p2 # 3 # 4 # 1", "ML"), ("c2_p2 # 3 # 4 # 1", "ML")
    ]


def test_build_resumes_without_repeating(spark, tmp_path):
    seqs = spark.createDataFrame([(i, "MKV" * (i + 1)) for i in range(10)], ["centroid_idx", "sequence"])
    path = str(tmp_path / "index")
    load = hashed_kmer_encoder(16)
    build.build_index(seqs.where("centroid_idx < 4"), load, path, chunk_size=3)
    done = build.build_index(seqs, load, path, chunk_size=3, resume=True)
    assert sorted(r.centroid_idx for r in done.collect()) == list(range(10))
    again = build.build_index(seqs, load, path, chunk_size=3, resume=True)
    assert again.count() == 10
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        build.build_index(seqs, load, path)
    assert {r.chunk for r in again.select("chunk").distinct().collect()} == {0, 1, 2, 3}
    assert done.select(F.size("embedding")).distinct().first()[0] == 16
