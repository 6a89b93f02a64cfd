"""Half-precision vectors and Zstandard FASTA as data sources."""

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from conftest import rows
from kinspark.sources import fasta, formats, vectors


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    formats.register_formats(spark)


def test_half_vectors_round_trip(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(500, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "centroid_idx long, embedding array<float>")
    path = str(tmp_path / "vectors")
    df.repartitionByRange(5, "centroid_idx").sortWithinPartitions("centroid_idx").write.format("half_vectors").option("dim", 12).mode("append").save(path)
    back = spark.read.format("half_vectors").option("dim", 12).load(path)
    want = [(i, v.astype(np.float16).astype(float).tolist()) for i, v in enumerate(m)]
    assert rows(back) == want == rows(vectors.read_fp16_vectors(spark, path, 12))
    assert rows(back.where("centroid_idx = 77")) == [want[77]]
    assert rows(back.where("centroid_idx > 490 and centroid_idx <= 495")) == want[491:496]
    # Written anew, nothing of the old files or of unfinished ones stays.
    df.where("centroid_idx < 3").coalesce(1).write.format("half_vectors").option("dim", 12).mode("overwrite").save(path)
    assert rows(spark.read.format("half_vectors").option("dim", 12).load(path)) == want[:3]
    assert not [f for f in (tmp_path / "vectors").iterdir() if f.name.startswith("_")]


def test_half_vector_ranges_and_conditions(tmp_path, monkeypatch):
    for k, n in enumerate((10, 0, 7)):
        (tmp_path / f"part-{k}.f16").write_bytes(np.arange(n * 4, dtype="<f2").tobytes())
    monkeypatch.setattr(formats, "RANGE_BYTES", 3 * 8)
    monkeypatch.setattr(formats, "BATCH_ROWS", 2)

    def keys(*filters):
        reader = formats._HalfReader(str(tmp_path), 4)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [b.column(0).to_pylist() for p in reader.partitions() for b in reader.read(p)]

    assert keys() == [[0, 1], [2], [3, 4], [5], [6, 7], [8], [9], [10, 11], [12], [13, 14], [15], [16]]
    at = ("centroid_idx",)
    assert keys(EqualTo(at, 12)) == [[10, 11], [12]]
    assert keys(GreaterThan(at, 8), LessThanOrEqual(at, 9)) == [[9]]
    assert keys(EqualTo(at, 99)) == []


def test_half_vectors_of_other_lengths_are_refused(spark, tmp_path):
    (tmp_path / "odd.f16").write_bytes(b"x" * 10)
    with pytest.raises(Exception, match="whole number"):
        spark.read.format("half_vectors").option("dim", 4).load(str(tmp_path / "odd.f16")).count()
    df = spark.createDataFrame([(0, [1.0, 2.0])], "centroid_idx long, embedding array<float>")
    with pytest.raises(Exception, match="must have 3"):
        df.write.format("half_vectors").option("dim", 3).mode("append").save(str(tmp_path / "new"))
    assert not list((tmp_path / "new").glob("part-*"))


RECORDS = [(f"name{k} é", "MK" * (k % 40 + 1)) for k in range(300)]


def test_zstd_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame(RECORDS, "name string, sequence string")
    path = str(tmp_path / "records")
    df.repartition(3).selectExpr("concat('>', name, '\\n', sequence) as value").write.format("zstd_fasta").mode("append").save(path)
    assert len(list((tmp_path / "records").iterdir())) == 3
    back = fasta.parse_records(spark.read.format("zstd_fasta").load(path))
    assert rows(back) == sorted(RECORDS) == rows(fasta.read_fasta(spark, path))
    empty = str(tmp_path / "none")
    df.limit(0).selectExpr("name as value").write.format("zstd_fasta").mode("append").save(empty)
    assert spark.read.format("zstd_fasta").load(empty).count() == 0


def test_frames_are_read_by_many_tasks_and_foreign_files_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "FRAME_BYTES", 500)
    text = "".join(f">{n}\n{s}\n" for n, s in RECORDS)
    values = pa.RecordBatch.from_arrays([pa.array([f">{n}\n{s}" for n, s in RECORDS] + [None])], ["value"])
    own, one, several = (tmp_path / f"{n}.fa.zst" for n in ("own", "one", "several"))
    with own.open("wb") as sink:
        assert formats._FrameWriter(str(tmp_path), False).encode(iter([values]), sink) == len(RECORDS)
    one.write_bytes(zstandard.ZstdCompressor().compress(text.encode()))
    cut = len(text) // 3
    several.write_bytes(b"".join(zstandard.ZstdCompressor().compress(text[k : k + cut].encode()) for k in range(0, len(text), cut)))
    monkeypatch.setattr(formats, "RANGE_BYTES", 600)
    for file, tasks in ((own, True), (one, False), (several, False)):
        reader = formats._FrameReader(str(file))
        parts = reader.partitions()
        assert (len(parts) > 3) == tasks and (tasks or len(parts) == 1)
        found = [v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()]
        df = spark.createDataFrame([(v,) for v in found], "value string")
        assert rows(fasta.parse_records(df)) == sorted(RECORDS)
    # The table is a frame that other readers skip.
    assert zstandard.ZstdDecompressor().stream_reader(own.open("rb"), read_across_frames=True).read().decode() == text
