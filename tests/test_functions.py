import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from kinspark.functions import hashing, headers, ranges, validation, vectors


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression).first()[0]


@pytest.mark.parametrize(
    "header",
    [">ERR1_7_1_SRR2_9_1 # 87 # 695 # -1", ">ERR1_7_1 SRR2_9_1 # 87 # 695 # -1"],
)
def test_member_header_layouts(spark, header):
    df = spark.createDataFrame([(header,)], ["h"])
    got = df.select(headers.member_accession("h"), headers.member_name("h")).first()
    assert tuple(got) == ("ERR1_7_1", "SRR2_9_1#87#695#-1")


def test_header_pieces(spark):
    header = "a # 1 # 2 # -1 # tail # more"
    assert one(spark, headers.truncate_header("h"), h=header) == "a # 1 # 2 # -1"
    assert one(spark, headers.record_id("h"), h="  id\tdescription") == "id"
    assert one(spark, headers.strip_marker("h"), h=">>x>y") == "x>y"
    assert one(spark, headers.model_text("s"), s="MK*L**") == "<+>MK*L"
    assert one(spark, headers.remove_whitespace("s"), s=" a\tb \n c") == "abc"
    assert one(spark, headers.composite_header("a", "b"), a="x", b="y") == "x#y"
    assert one(spark, headers.has_marker("s"), s="MK>L") is True


def test_drop_comments(spark):
    df = spark.createDataFrame([("#h",), ("",), ("  ",), ("x",), ("a#",)], ["v"])
    assert rows(headers.drop_comments(df, "v")) == [("a#",), ("x",)]


# Fixed values published for the hash.
@pytest.mark.parametrize("text,value", [("", 2166136261), ("a", 3826002220), ("foobar", 3214735720)])
def test_fnv_known_values(spark, text, value):
    assert one(spark, hashing.fnv1a32("s"), s=text) == value
    assert one(spark, hashing.bucket_dir("s"), s=text) == value % 10000
    assert one(spark, hashing.bucket_group("s"), s=text) == value // 10000 % 1000


def test_ranges_round_trip(spark):
    df = spark.range(0, 1000, 37)
    shard, local = ranges.range_shard("id", 100), ranges.local_index("id", 100)
    assert df.where(ranges.global_index(shard, local, 100) != F.col("id")).isEmpty()


def test_validation(spark):
    df = spark.createDataFrame([("a", "MKL"), ("b", ""), ("c", "ACGTNacgtn"), ("", "MK")], ["name", "sequence"])
    assert rows(validation.validation_report(df)) == [
        ("empty_sequence", 1),
        ("missing_header", 1),
        ("nucleotide_sequence", 1),
    ]
    with pytest.raises(ValueError, match="nucleotide_sequence"):
        validation.validate(df)
    assert rows(validation.validate(df, strict=False)) == [("a", "MKL")]


finite = st.lists(st.floats(-1, 1, width=32).filter(lambda x: abs(x) > 1e-3), min_size=4, max_size=4)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(finite, finite), min_size=1, max_size=8))
def test_squared_l2_is_twice_cosine_on_unit_vectors(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    unit = df.select(vectors.normalise("a").alias("a"), vectors.normalise("b").alias("b"))
    left, right = vectors.squared_l2("a", "b"), vectors.cosine_to_squared_l2(vectors.cosine_distance("a", "b"))
    assert unit.where(F.abs(left - right) > 1e-6).isEmpty()


def test_half_precision(spark):
    values = [0.1, -1.5, 3.14159]
    df = spark.createDataFrame([(values,)], "v array<float>")
    got = df.select(vectors.half_precision("v")).first()[0]
    assert got == np.array(values, dtype=np.float16).astype(np.float32).tolist()


def test_unit_norm(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.6, 0.8005],), ([2.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.is_unit("v")).collect()] == [True, True, False]
