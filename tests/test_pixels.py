"""Vector-valued means, and pixels inside an export."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from setwright.operators import mean
from setwright.plans.export import export, verify_local
from setwright.sources.job import Field, Job

JOB = Job(0, "demo", (Field(0, 10, "pixels"), Field(1, 11, "label")), {"train": 100})
ENTRY = "array<struct<type string, dtype string, id int, channels int, width int, height int, filename string, url string, value string>>"


def md5(data: bytes) -> str:
    return hashlib.md5(data).hexdigest()


def png(pixels: np.ndarray) -> bytes:
    """Grey or RGB pictures of rows of pixels."""
    height, width = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def feed_of(spark, *items):
    """Records of one blob entry each, and their assets: ``(type, dtype, channels, content)``."""
    import json

    from setwright.sources import feed

    records = [
        {"set": "train", "hash": md5(f"{k}".encode()), "data": [
            {"type": kind, "dtype": dtype, "id": 0, "channels": channels, "width": 2, "height": 1, "filename": md5(content) + ".bin", "url": f"http://h/{k}"},
            {"type": "string", "id": 1, "value": f"r{k}"},
        ]} for k, (kind, dtype, channels, content) in enumerate(items)
    ]
    pages = spark.createDataFrame([(0, json.dumps(records))], "page int, body string")
    rows = feed.read_feed(pages, JOB.fields).withColumn("seq", F.struct("page", "pos"))
    return rows, spark.createDataFrame([(f"http://h/{k}", i[3]) for k, i in enumerate(items)], "url string, content binary")


def tensors_of(spark, out):
    rows = spark.read.parquet(f"{out}/tensors").select("pixels.*", F.col("label.data").cast("string").alias("label")).collect()
    return {r["label"]: (r["dtype"], np.frombuffer(r["data"], "<f4" if r["dtype"] == "float" else np.uint8).tolist()) for r in rows}


def floats(*values) -> bytes:
    return np.array(values, "<f4").tobytes()


def test_pixel_sums_of_uneven_tensors(spark, monkeypatch):
    """Several blocks and merge steps; nulls and missing places do not count."""
    monkeypatch.setattr(mean, "BLOCK", 3)
    monkeypatch.setattr(mean, "FAN", 2)
    rng = np.random.default_rng(3)
    rows = [([None if rng.random() < 0.1 else float(x) for x in rng.normal(0, 1, rng.integers(0, 11))],) for _ in range(200)] + [(None,)]
    df = spark.createDataFrame(rows, "t array<float>").repartition(7)
    got = {r["i"]: r["m"] for r in mean.image_mean(df, "t", "pixel").collect()}
    for i in range(10):
        there = [np.float32(t[i]) for (t,) in rows if t and len(t) > i and t[i] is not None]
        assert abs(got[i] - np.mean(there, dtype=np.float64)) < 1e-9
    (total,) = mean.image_mean(df, "t", "global").collect()
    assert abs(total["m"] - np.mean([np.float32(x) for (t,) in rows for x in t or [] if x is not None], dtype=np.float64)) < 1e-9
    assert mean.image_mean(df.limit(0), "t", "pixel").count() == 0 and mean.image_mean(df.limit(0), "t", "channel", 2).count() == 0


@pytest.mark.parametrize("kind", mean.KINDS)
def test_no_plan_has_a_row_per_pixel(spark, kind):
    df = spark.createDataFrame([([1.0, 2.0],)], "t array<float>")
    vector = mean.mean_vector(df, "t", kind, 2)
    assert "Generate" not in vector._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind,want", [("global", [-2.5, -0.5, 1.5, 1.5]), ("channel", [-2.0, -1.0, 2.0, 1.0]), ("pixel", [-2.0, -1.0, 2.0, 1.0])])
def test_subtracted_export(spark, tmp_path, kind, want):
    good = [("raw", "float", 2, floats(1, 3)), ("raw", "float", 2, floats(5, 5)), ("raw", "float", 2, floats(1, 2, 3)), ("raw", "uint8", 2, b"\x03\x04")]
    records, assets = feed_of(spark, *good[:3])
    done = export(records, JOB, str(tmp_path), "tensor", assets, subtract=kind, mean_format="csv")
    assert [r["reason"] for r in done.rejects.collect()] == ["unequal_dimensions"]
    got = tensors_of(spark, str(tmp_path))
    assert got["r0"] == ("float", want[:2]) and got["r1"] == ("float", want[2:])
    assert verify_local(spark, str(tmp_path), "tensor").first() == (2, 0)
    assert spark.read.option("header", True).csv(f"{tmp_path}/mean").count() == {"global": 1, "channel": 2, "pixel": 2}[kind]


def test_subtracted_blobs_outside(spark, tmp_path):
    """Formats without blobs get the differences as files, named by what they hold."""
    records, assets = feed_of(spark, ("raw", "uint8", 1, b"\x02\x04"), ("raw", "uint8", 1, b"\x04\x08"))
    done = export(records, JOB, str(tmp_path), "csv", assets, subtract="pixel")
    assert done.written.count() == 2
    for content in (floats(-1, -2), floats(1, 2)):
        name = md5(content)
        assert (tmp_path / "data" / name[0] / name[1] / name[2] / f"{name}.bin").read_bytes() == content


def test_decoded_images(spark, tmp_path):
    grey, colour = np.array([[1, 2], [3, 4], [5, 6]], np.uint8), np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    items = [("image", None, 1, png(grey)), ("image", None, 3, png(colour)), ("image", None, 1, b"no image"), ("image", None, 1, png(grey))]
    records, assets = feed_of(spark, *items)
    out = str(tmp_path / "plain")
    done = export(records, JOB, out, "tensor", assets, decode=True)
    assert [r["reason"] for r in done.rejects.collect()] == ["undecodable_image"]
    got = tensors_of(spark, out)
    assert got["r0"] == got["r3"] == ("uint8", grey.ravel().tolist())
    assert got["r1"] == ("uint8", colour[:, :, ::-1].ravel().tolist())
    shape = spark.read.parquet(f"{out}/tensors").filter("label.data = binary('r1')").select("pixels.*").first()
    assert (shape["channels"], shape["width"], shape["height"]) == (3, 2, 2)
    less = str(tmp_path / "less")
    done = export(records, JOB, less, "tfrecords", assets, subtract="pixel")
    assert sorted(r["reason"] for r in done.rejects.collect()) == ["undecodable_image", "unequal_dimensions"]
    back = spark.read.format("tfrecord").schema("pixels binary").load(f"{less}/records").collect()
    assert [np.frombuffer(r["pixels"], "<f4").tolist() for r in back] == [[0.0] * 6] * 2


def test_iterations_and_options(spark, tmp_path):
    records, assets = feed_of(spark, ("raw", "uint8", 1, b"ab"), ("raw", "uint8", 1, b"cd"))
    out = str(tmp_path / "i")
    export(records, JOB, out, "jsonl", assets, iterations=3)
    assert verify_local(spark, out, "jsonl").first() == (6, 0)
    for options in ({"subtract": "median"}, {"mean_format": "csv"}):
        with pytest.raises(ValueError):
            export(records, JOB, out, "jsonl", assets, **options)
    with pytest.raises(ValueError):
        export(records, JOB, out, "jsonl", decode=True)
    empty = str(tmp_path / "e")
    assert export(records.limit(0), JOB, empty, "tensor", assets, subtract="pixel").written.count() == 0
