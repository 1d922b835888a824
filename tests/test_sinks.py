"""The TFRecord and blob-file formats."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from setwright.sinks import blobfiles, tfrecord
from setwright.sinks.crc32c import masked_crc32c
from setwright.sinks.example_proto import decode_example, encode_example


def slow_masked_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksum_of_the_published_example():
    # The check value of CRC-32C over "123456789" is E3069283.
    unmasked = 0xE3069283
    want = (((unmasked >> 15) | (unmasked << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    assert masked_crc32c([b"123456789"]).tolist() == [want]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=12))
def test_checksum_model(strings):
    assert masked_crc32c(strings).tolist() == [slow_masked_crc(s) for s in strings]


@settings(max_examples=50, deadline=None)
@given(
    st.dictionaries(
        st.text(max_size=5),
        st.one_of(
            st.tuples(st.just("int64"), st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=4)),
            st.tuples(st.just("bytes"), st.lists(st.binary(max_size=200), min_size=1, max_size=4)),
            st.tuples(st.just("float"), st.lists(st.floats(width=32, allow_nan=False), min_size=1, max_size=4)),
        ),
        max_size=5,
    )
)
def test_example_round_trip(features):
    assert decode_example(encode_example(features)) == {k: v for k, (_, v) in features.items()}


def test_example_does_not_depend_on_order():
    a = encode_example({"x": ("int64", [1]), "y": ("bytes", [b"b"])})
    assert a == encode_example({"y": ("bytes", [b"b"]), "x": ("int64", [1])})


def sample(spark, n=500):
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 7, "train").otherwise("test").alias("set"),
        F.col("id").alias("n"),
        (F.col("id") / 4).cast("float").alias("x"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"),
        F.when(F.col("id") % 2 == 0, F.array(F.col("id"), F.col("id") + 1)).alias("l"),
    )


SCHEMA = "_set string, n long, x float, s string, l array<long>"


def test_tfrecord_round_trip(spark, tmp_path, rows):
    tfrecord.register(spark)
    path = f"file:{tmp_path}/out"
    sample(spark).write.format("tfrecord").mode("append").save(path)
    back = spark.read.format("tfrecord").schema(SCHEMA).load(path)
    assert rows(back) == rows(sample(spark).withColumnRenamed("set", "_set"))
    sample(spark, 20).write.format("tfrecord").mode("append").save(path)
    assert spark.read.format("tfrecord").load(path).count() == 520
    sample(spark, 30).write.format("tfrecord").mode("overwrite").save(path)
    assert spark.read.format("tfrecord").load(path).count() == 30
    assert not list(tmp_path.glob("out/_temporary/*"))


def shard_sizes(path):
    return {f: f.stat().st_size for f in path.rglob("*.tfrecord")}


def test_shards_by_entries_and_bytes(spark, tmp_path):
    tfrecord.register(spark)
    df = sample(spark).coalesce(1)
    df.write.format("tfrecord").option("entriesPerShard", 100).mode("append").save(str(tmp_path / "e"))
    counts = spark.read.format("tfrecord").load(str(tmp_path / "e")).groupBy("_set", "_file").count().collect()
    assert sorted((r["_set"], r["count"]) for r in counts) == sorted(
        [("train", 100)] * 3 + [("train", 50)] + [("test", 100)] + [("test", 50)]
    )
    limit = 2000
    df.write.format("tfrecord").option("maxShardBytes", limit).mode("append").save(str(tmp_path / "b"))
    files = spark.read.format("tfrecord").load(str(tmp_path / "b")).groupBy("_set", "_file").agg(
        F.max(F.octet_length("_record")).alias("r")
    )
    sizes = {str(f): s for f, s in shard_sizes(tmp_path / "b").items()}
    largest = {r["_file"]: r["r"] + 16 for r in files.collect()}
    # A shard is closed by the record that reaches the limit: it is full, and by less than that record over.
    assert all(s < limit + largest[f] for f, s in sizes.items())
    for name in ("train", "test"):
        mine = sorted(f for f in sizes if f"set={name}/" in f)
        assert all(sizes[f] >= limit for f in mine[:-1]) and len(mine) > 3


def flip(path, at):
    data = bytearray(path.read_bytes())
    data[at] ^= 1
    path.write_bytes(bytes(data))


def test_damage_is_noticed(spark, tmp_path):
    tfrecord.register(spark)
    sample(spark, 50).coalesce(1).write.format("tfrecord").mode("append").save(str(tmp_path))
    (file, *_) = sorted(tmp_path.rglob("*.tfrecord"))
    flip(file, 20)
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("tfrecord").load(str(tmp_path)).count()
    kept = spark.read.format("tfrecord").option("checksums", "ignore").load(str(tmp_path))
    assert kept.count() == 50
    flip(file, 20)
    file.write_bytes(file.read_bytes()[:-1])
    with pytest.raises(Exception, match="ends inside"):
        spark.read.format("tfrecord").load(str(tmp_path)).count()


def test_framing_is_the_published_one():
    (data,) = tfrecord.frame([b"abc"])
    length = struct.pack("<Q", 3)
    assert data == length + struct.pack("<I", slow_masked_crc(length)) + b"abc" + struct.pack("<I", slow_masked_crc(b"abc"))


def test_failed_task_leaves_no_records(spark, tmp_path):
    tfrecord.register(spark)
    bad = sample(spark).withColumn("n", F.when(F.col("n") == 400, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="boom"):
        bad.write.format("tfrecord").mode("append").save(str(tmp_path / "o"))
    # A task that was killed while the job was undone may leave a temporary file; none is a shard.
    left = [f.relative_to(tmp_path / "o") for f in (tmp_path / "o").rglob("*.tfrecord")]
    assert all(f.parts[0] == "_temporary" for f in left)
    assert spark.read.format("tfrecord").load(str(tmp_path / "o")).count() == 0


def test_options_are_checked(spark, tmp_path):
    tfrecord.register(spark)
    with pytest.raises(Exception, match="no set column"):
        sample(spark).drop("set").write.format("tfrecord").mode("append").save(str(tmp_path))
    from setwright.sinks.writers import WRITERS

    with pytest.raises(ValueError, match="unknown options"):
        WRITERS["csv"].check_options({"entriesPerShard": 1})


def test_blob_files(spark, tmp_path):
    blobfiles.register(spark)
    df = spark.range(40).select(
        F.concat(F.lit("data/"), F.col("id").cast("string"), F.lit(".bin")).alias("path"),
        F.col("id").cast("string").cast("binary").alias("content"),
    )
    for _ in range(2):  # the same names and bytes again
        df.write.format("blobfiles").mode("append").save(str(tmp_path))
    files = list((tmp_path / "data").iterdir())
    assert len(files) == 40 and (tmp_path / "data" / "7.bin").read_bytes() == b"7"


def test_small_shards_share_a_task(spark, tmp_path):
    """Tasks grow with the bytes, not with the number of shards; large files are read by themselves."""
    tfrecord.register(spark)
    sample(spark, 400).coalesce(1).write.format("tfrecord").option("entriesPerShard", 5).mode("append").save(str(tmp_path))
    files = list(tmp_path.rglob("*.tfrecord"))
    back = spark.read.format("tfrecord").load(str(tmp_path))
    assert len(files) >= 80 and back.rdd.getNumPartitions() <= 3
    assert (back.count(), back.select("_file").distinct().count()) == (400, len(files))
    assert back.groupBy("_file").count().filter("count > 5").isEmpty()


def test_bundles_hold_every_file_once():
    infos = [tfrecord.fs.FileInfo(f"f{i}", size=size) for i, size in enumerate((40 << 20, 1, 1, 20 << 20, 20 << 20, 0))]
    assert tfrecord.bundled(infos) == [["f0"], ["f1", "f2", "f3"], ["f4", "f5"]]
    assert tfrecord.bundled([]) == []
