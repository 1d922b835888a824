"""Scalar functions against small Python models."""

import hashlib
import random
import struct

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from setwright.functions import tensors, text

WORDS = st.text(alphabet="ab ;=,.é", max_size=6)


def apply(spark, values, schema, column):
    df = spark.createDataFrame([(v,) for v in values], schema).coalesce(1)
    return [r[0] for r in df.select(column).collect()]


def model_split(s, d):
    parts = s.split(d)
    return parts[:-1] if parts[-1] == "" else parts


def model_join(tokens, d):
    out = ""
    for t in tokens:
        out += (d if out else "") + t
    return out


def model_pairs(s):
    out = {}
    for p in model_split(s, ";"):
        kv = p.split("=")
        out.setdefault(kv[0], kv[1] if len(kv) > 1 else "")
    return out


def test_split_fixed(spark):
    got = apply(spark, ["a;b;", "a;;", "", "a", ";"], "x string", text.split_tokens("x", ";"))
    assert got == [["a", "b"], ["a", ""], [], ["a"], [""]]


@settings(max_examples=5, deadline=None)
@given(st.lists(WORDS, min_size=40, max_size=40))
def test_split_model(spark, values):
    assert apply(spark, values, "x string", text.split_tokens("x", ";")) == [model_split(v, ";") for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=5), min_size=40, max_size=40))
def test_join_model(spark, values):
    assert apply(spark, values, "x array<string>", text.join_tokens("x")) == [model_join(v, ", ") for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS, WORDS), min_size=40, max_size=40))
def test_join_fields_is_join_tokens(spark, values):
    df = spark.createDataFrame(values, "a string, b string, c string").coalesce(1)
    line = text.join_fields([F.col("a"), F.col("b"), F.col("c")])
    assert [r[0] for r in df.select(line).collect()] == [model_join(v, " ") for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(WORDS, min_size=40, max_size=40))
def test_key_values_model(spark, values):
    assert apply(spark, values, "x string", text.key_values("x")) == [model_pairs(v) for v in values]


def test_key_values_fixed(spark):
    got = apply(spark, ["hash=a;file=x=y;hash=b"], "x string", text.key_values("x"))
    assert got == [{"hash": "a", "file": "x"}]


def test_float_text_equals_c(spark):
    r = random.Random(5)
    values = [struct.unpack("<f", r.randbytes(4))[0] for _ in range(20000)]
    values += [k / 128 for k in range(-400, 400)] + [r.uniform(-1e7, 1e7) for _ in range(3000)]
    values += [0.1, 0.0078125, 1234.5678, 123456789.0, -1e-9, -0.0, 1e9, 2.0**62, 3.4e38]
    values += [float("inf"), float("-inf")]
    values = [float(np.float32(v)) for v in values if v == v]
    got = apply(spark, values, "x double", text.float_text("x"))
    assert [(v, g) for v, g in zip(values, got) if g != "%f" % np.float32(v)] == []
    assert apply(spark, [float("nan"), None], "x double", text.float_text("x")) == ["nan", None]


def test_float_text_fixed(spark):
    values = [0.1, 0.0078125, 1234.5678, 123456789.0, -1e-9]
    got = apply(spark, values, "x double", text.float_text("x"))
    assert got == ["0.100000", "0.007812", "1234.567749", "123456792.000000", "-0.000000"]


def test_names_and_paths(spark):
    assert apply(spark, ["ab.cd.jpg", "abc"], "x string", text.base_name("x")) == ["ab", "abc"]
    names = ["abcdefgh", "abc.jpg"]
    assert apply(spark, names, "x string", text.blob_path("x")) == ["data/a/b/c/abcdefgh", "data/abc.jpg"]
    assert apply(spark, names, "x string", text.blob_path("x", "/w/", tree=False)) == [
        "/w/data/abcdefgh",
        "/w/data/abc.jpg",
    ]
    assert apply(spark, ["train12.h5", "a1.h5x"], "x string", text.set_of_shard("x")) == ["train", "ax"]
    digest = hashlib.md5(b"http://h/a").hexdigest()
    for dtype, suffix in (("jpeg", ".jpg"), ("png", ".png"), ("uint8", "")):
        got = apply(spark, ["http://h/a"], "x string", text.default_filename("x", F.lit(dtype)))
        assert got == [digest + suffix]


def test_hash_text(spark):
    given_ = ["ab", "aB09", "abc", "zz", "", None]
    assert apply(spark, given_, "x string", text.is_hash_text("x")) == [True, True, False, False, False, False]
    assert apply(spark, given_, "x string", text.bytes_to_hex(text.hex_to_bytes("x"))) == ["ab", "ab09"] + [None] * 4


def test_replace_and_ends(spark):
    assert apply(spark, ["aXbX", "$X"], "x string", text.replace_all("x", "X", "$1")) == ["a$1b$1", "$$1"]
    assert apply(spark, ["a#top", "#to"], "x string", text.ends_with("x", "#top")) == [True, False]


def test_tensor_bytes(spark):
    values = [[1.0, -2.5], None, [], [3.25], [0.1] * 7]
    df = spark.createDataFrame([(v,) for v in values], "v array<float>").coalesce(1)
    packed = [r[0] for r in df.select(tensors.encode_f32("v")).collect()]
    want = [None if v is None else np.array(v, "<f4").tobytes() for v in values]
    assert [None if p is None else bytes(p) for p in packed] == want
    back = df.select(tensors.decode_f32(tensors.encode_f32("v")).alias("w"), "v")
    assert all(r.w == r.v for r in back.collect())
    odd = spark.createDataFrame([(b"1234567",), (b"\x00\xff",)], "b binary").coalesce(1)
    assert [r[0] for r in odd.select(tensors.decode_f32("b")).collect()] == [None, None]
    assert [r[0] for r in odd.select(tensors.decode_u8("b")).collect()][1] == [0.0, 255.0]


def test_tensor_bytes_of_sliced_batches(spark):
    """Batches that start inside a buffer keep their own rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(20).select(
            "id", F.slice(F.sequence(F.lit(0), F.lit(30)), 1, F.col("id").cast("int")).cast("array<float>").alias("v")
        )
        same = tensors.decode_f32(tensors.encode_f32("v")).eqNullSafe(F.col("v"))
        assert df.filter(~same).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
