"""Whole exports: every format, archives, blobs, resume, verification, damage."""

import hashlib
import io
import json
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from setwright.operators.ledger import Ledger
from setwright.plans.export import export, ledger_path, repeated, verify_against_feed, verify_local
from setwright.sinks.writers import WRITERS
from setwright.sources import archives, assets, feed
from setwright.sources.job import Field, Job

FIELDS = (Field(0, 10, "source"), Field(1, 11, "label"), Field(2, 12, "n"), Field(3, 13, "score"))
JOB = Job(100, "demo", FIELDS, {"train": 70, "test": 30})


def md5(data: bytes) -> str:
    return hashlib.md5(data).hexdigest()


def body(i: int) -> bytes:
    return f"payload {i}".encode()


def tar(members: dict[str, bytes], mode="w:gz") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def manifest(*names: str) -> bytes:
    return json.dumps([{"type": "raw", "dtype": "uint8", "id": 0, "filename": n} for n in names]).encode()


def record(i: int, label="cat", **changes) -> dict:
    data = [
        {"type": "raw", "dtype": "uint8", "id": 0, "filename": md5(body(i)) + ".bin", "url": f"http://h/{i}"},
        {"type": "string", "fieldid": 11, "value": label},
        {"type": "numeric", "dtype": "int", "id": 2, "value": i},
        {"type": "numeric", "dtype": "float", "name": "score", "value": i / 4},
    ]
    return {"set": "train" if i % 3 else "test", "hash": md5(f"r{i}".encode()), "data": data, **changes}


def archive_record(i: int, url: str) -> dict:
    return {
        "set": "train",
        "hash": md5(f"a{i}".encode()),
        "data": [{"type": "archive", "url": url}, {"type": "string", "id": 1, "value": "boxed"}],
    }


MEMBERS = {md5(b"m%d" % i) + ".bin": b"m%d" % i for i in range(3)}
TARS = {
    "http://a/good": tar({**MEMBERS, "file_id.diz": manifest(*MEMBERS)}),
    "http://a/junk": b"junk",
    "http://a/bare": tar(MEMBERS, "w"),
    "http://a/lacks": tar({**MEMBERS, "file_id.diz": manifest(*MEMBERS, "gone.bin")}),
    "http://a/badlist": tar({**MEMBERS, "file_id.diz": b"{}"}),
}


def read(spark, *records):
    pages = spark.createDataFrame([(0, json.dumps(list(records)))], "page int, body string")
    return feed.read_feed(pages, FIELDS).withColumn("seq", F.struct("page", "pos"))


@pytest.fixture(scope="module")
def payloads(spark):
    rows = [(f"http://h/{i}", body(i)) for i in range(40)] + list(TARS.items())
    rows.append(("http://h/empty", b""))
    return spark.createDataFrame(rows, "url string, content binary")


GOOD = [record(i, "cat" if i % 2 else "dog") for i in range(12)]


@pytest.mark.parametrize("fmt", sorted(WRITERS))
def test_every_format_writes_and_verifies(spark, payloads, tmp_path, fmt):
    out = str(tmp_path)
    done = export(read(spark, *GOOD), JOB, out, fmt, payloads)
    assert (done.written.count(), done.rejects.count()) == (12, 0)
    assert verify_local(spark, out, fmt).first() == (12, 0)
    assert verify_against_feed(read(spark, *GOOD, record(30)), out).first() == (12, 1, 0)
    again = export(read(spark, *GOOD, record(20)), JOB, out, fmt, payloads, mode="resume", batch="1")
    assert again.written.count() == 1
    assert verify_local(spark, out, fmt).first() == (13, 0)


def test_third_run_writes_nothing_and_a_new_one_truncates(spark, payloads, tmp_path):
    out, fmt = str(tmp_path), "csv"
    export(read(spark, *GOOD, record(20)), JOB, out, fmt, payloads)
    third = export(read(spark, *GOOD, record(20)), JOB, out, fmt, payloads, mode="resume", batch="2")
    assert third.written.count() == 0
    assert verify_local(spark, out, fmt).first() == (13, 0)
    fresh = export(read(spark, *GOOD[:2]), JOB, out, fmt, payloads, mode="new")
    assert fresh.written.count() == 2
    assert verify_local(spark, out, fmt).first() == (2, 0)


def test_text_lines_are_exact(spark, payloads, tmp_path):
    out = str(tmp_path)
    export(read(spark, record(5, 'a "b"')), JOB, out, "csv", payloads)
    name = md5(body(5)) + ".bin"
    path = f"{out}/data/{name[0]}/{name[1]}/{name[2]}/{name}"
    line = spark.read.text(f"{out}/lines").first()["value"]
    assert line == f'{path} "a "b"" 5 1.250000'
    assert open(path, "rb").read() == body(5)
    (row,) = Ledger.open(spark, ledger_path(out)).hashes().collect()
    assert row["record_hash"].hex() == md5(line.encode())


def test_flat_blobs_and_escapes(spark, payloads, tmp_path):
    out = str(tmp_path)
    broken = export(read(spark, record(5, "a\nb")), JOB, out, "csv", payloads, tree=False)
    assert [r["reason"] for r in broken.rejects.collect()] == ["line_break_in_value"]
    export(read(spark, record(5, 'a\n"b\\')), JOB, out, "csv", payloads, tree=False, escape=True)
    line = spark.read.text(f"{out}/lines").first()["value"]
    assert line == f'{out}/data/{md5(body(5))}.bin "a\\n\\"b\\\\" 5 1.250000'
    assert verify_local(spark, out, "csv").first() == (1, 0)


def test_image_list_ids_go_on_after_a_resume(spark, payloads, tmp_path):
    out = str(tmp_path)
    two = Job(0, "demo", FIELDS[:2], JOB.splits)
    export(read(spark, record(1, "b"), record(2, "a"), record(3, "b")), two, out, "imagelist", payloads)
    export(read(spark, record(4, "c"), record(5, "a")), two, out, "imagelist", payloads, mode="resume", batch="1")
    lines = [r["value"].rsplit("/", 1)[1] for r in spark.read.text(f"{out}/lines").collect()]
    want = {1: 0, 2: 1, 3: 0, 4: 2, 5: 1}
    assert sorted(lines) == sorted(f"{md5(body(i))}.bin {k}" for i, k in want.items())
    labels = {r["label"]: r["category_id"] for r in Ledger.open(spark, ledger_path(out)).table("labels").collect()}
    assert labels == {"b": 0, "a": 1, "c": 2}


def test_tfrecord_holds_the_bytes(spark, payloads, tmp_path):
    export(read(spark, record(7)), JOB, str(tmp_path), "tfrecords", payloads)
    schema = "source binary, label string, n long, score float"
    (row,) = spark.read.format("tfrecord").schema(schema).load(f"{tmp_path}/records").collect()
    assert (bytes(row["source"]), row["label"], row["n"], row["score"]) == (body(7), "cat", 7, 1.75)
    out = str(tmp_path / "outside")
    export(read(spark, record(7)), JOB, out, "tfrecords", payloads, blobs="external")
    (row,) = spark.read.format("tfrecord").schema(schema).load(f"{out}/records").collect()
    assert open(bytes(row["source"]).decode(), "rb").read() == body(7)


@pytest.mark.parametrize("fmt", ["csv", "tfrecords"])
def test_bad_records_are_refused_and_stop_nothing(spark, payloads, tmp_path, fmt):
    wrong_name = record(8)
    wrong_name["data"][0]["filename"] = md5(b"other") + ".bin"
    raw = lambda **k: {**record(9)["data"][0], **k}
    given = [
        record(1),
        record(2, hash="abc"),
        record(3, set="nowhere"),
        record(4, hash=md5(b"x4"), data=[raw(url="http://h/none")]),
        record(5, hash=md5(b"x5"), data=[raw(url="http://h/empty")]),
        record(6, hash=md5(b"x6"), data=[raw(dtype="float16")]),
        record(7, hash=md5(b"x7"), data=[raw(dtype="float")]),
        wrong_name,
        record(1),
        archive_record(1, "http://a/junk"),
        archive_record(2, "http://a/bare"),
        archive_record(3, "http://a/badlist"),
    ]
    done = export(read(spark, *given), JOB, str(tmp_path), fmt, payloads)
    reasons = {r["api_hash"]: r["reason"] for r in done.rejects.collect()}
    want = {
        "abc": "bad_hash",
        given[2]["hash"]: "unknown_set",
        md5(b"x4"): "missing_payload",
        md5(b"x5"): "missing_payload",
        md5(b"x6"): "bad_raw_dtype",
        md5(b"x7"): "bad_raw_length",
        given[9]["hash"]: "broken_archive",
        given[10]["hash"]: "no_manifest",
        given[11]["hash"]: "bad_manifest",
    }
    if fmt == "csv":
        want[wrong_name["hash"]] = "name_is_not_content_hash"
    assert reasons == want
    assert done.written.count() == (1 if fmt == "csv" else 2)
    assert verify_local(spark, str(tmp_path), fmt).first()["not_found"] == 0


@pytest.mark.parametrize("fmt", ["csv", "tfrecords"])
def test_archives_become_records(spark, payloads, tmp_path, fmt):
    out = str(tmp_path)
    given = [record(1), archive_record(1, "http://a/good"), archive_record(2, "http://a/lacks")]
    done = export(read(spark, *given), JOB, out, fmt, payloads)
    assert [r["reason"] for r in done.rejects.collect()] == ["missing_member"]
    per_hash = {r["api_hash"]: r["count"] for r in done.written.groupBy("api_hash").count().collect()}
    assert per_hash == {given[0]["hash"]: 1, given[1]["hash"]: 3, given[2]["hash"]: 3}
    assert verify_local(spark, out, fmt).first() == (7, 0)
    if fmt == "csv":
        for name, data in MEMBERS.items():
            assert open(f"{out}/data/{name[0]}/{name[1]}/{name[2]}/{name}", "rb").read() == data


def test_zip_archives_and_equal_member_names(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.bin", b"zip")
        z.writestr("file_id.diz", manifest("x.bin"))
    rows = [(1, out.getvalue()), (2, tar({"x.bin": b"tar", "file_id.diz": manifest("x.bin"), "y.bin": b"y"}))]
    df = spark.createDataFrame([*rows, (3, None)], "id int, content binary")
    got = {(r["id"], r["member"], r["body"] and bytes(r["body"]), r["manifest_pos"], r["error"]) for r in archives.unpack(df).collect()}
    assert got == {
        (1, "x.bin", b"zip", 0, None),
        (2, "x.bin", b"tar", 0, None),
        (2, "y.bin", b"y", None, None),
        (3, None, None, None, "missing_payload"),
    }


def test_one_changed_byte_is_found(spark, payloads, tmp_path):
    out = str(tmp_path)
    export(read(spark, *GOOD), JOB, out, "csv", payloads)
    (file, *_) = sorted((tmp_path / "lines").rglob("part-*"))
    text = file.read_bytes()
    at = text.index(b'"') + 1
    file.write_bytes(text[:at] + bytes([text[at] ^ 1]) + text[at + 1 :])
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert verify_local(spark, out, "csv").first() == (11, 1)


def test_a_batch_that_is_written_again_replaces_itself(spark, payloads, tmp_path):
    out = str(tmp_path)
    export(read(spark, *GOOD[:5]), JOB, out, "jsonl", payloads)
    for _ in range(2):
        export(read(spark, *GOOD), JOB, out, "jsonl", payloads, mode="resume", batch="1")
    ledger = Ledger.open(spark, ledger_path(out))
    assert (ledger.hashes().count(), ledger.hashes().select("api_hash").distinct().count()) == (12, 12)
    assert verify_local(spark, out, "jsonl").first() == (12, 0)
    assert spark.read.text(f"{out}/lines").count() == 12


def test_split_runs_leave_the_ledger_of_one_run(spark, payloads, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    export(read(spark, *GOOD), JOB, one, "jsonl", blobs="external", assets=payloads)
    export(read(spark, *GOOD[:7]), JOB, two, "jsonl", payloads)
    export(read(spark, *GOOD), JOB, two, "jsonl", payloads, mode="resume", batch="1")
    api = lambda p: {bytes(r["api_hash"]) for r in Ledger.open(spark, ledger_path(p)).hashes().collect()}
    assert api(one) == api(two) and len(api(one)) == 12


def test_resume_needs_a_ledger(spark, payloads, tmp_path):
    with pytest.raises(FileNotFoundError):
        export(read(spark, *GOOD), JOB, str(tmp_path), "csv", payloads, mode="resume")


def test_iterations(spark):
    r = repeated(read(spark, *GOOD), 3)
    assert r.groupBy("iteration").count().orderBy("iteration").collect() == [(0, 12), (1, 12), (2, 12)]


def png(width: int, height: int, rgb: bytes) -> bytes:
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + rgb[r * width * 3 : (r + 1) * width * 3] for r in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images_decode_to_bgr(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(2, 1, bytes([255, 0, 10, 0, 128, 20])))
    (tmp_path / "b.png").write_bytes(b"not a picture")
    got = {r["origin"][-5:]: r for r in assets.read_images(spark, str(tmp_path)).collect()}
    a, b = got["a.png"], got["b.png"]
    assert (a["height"], a["width"], a["channels"], a["ok"]) == (1, 2, 3, True)
    assert bytes(a["data"]) == bytes.fromhex("0a00ff148000")
    assert (b["height"], b["ok"]) == (-1, False)


def test_asset_files_and_copies(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"x")
    files = assets.read_asset_files(spark, str(tmp_path)).collect()
    assert [(r["url"][-5:], bytes(r["content"])) for r in files] == [("x.bin", b"x")]
    copies = spark.createDataFrame([("u", b"1"), ("u", b"2"), ("v", b"3")], "url string, content binary")
    got = {r["url"]: bytes(r["content"]) for r in assets.distinct_assets(copies).collect()}
    assert got == {"u": min((b"1", b"2"), key=md5), "v": b"3"}


def test_resume_without_a_batch_name_adds(spark, payloads, tmp_path):
    out = str(tmp_path)
    export(read(spark, *GOOD[:5]), JOB, out, "jsonl", payloads)
    export(read(spark, *GOOD[5:]), JOB, out, "jsonl", payloads, mode="resume")
    assert verify_local(spark, out, "jsonl").first() == (12, 0)
    assert Ledger.open(spark, ledger_path(out)).hashes().count() == 12


def test_assets_listed_twice(spark, payloads, tmp_path):
    twice = payloads.unionByName(payloads).unionByName(spark.createDataFrame([("http://h/3", body(3) + b"!")], "url string, content binary"))
    boxed = archive_record(1, "http://a/good")
    for fmt in ("jsonl", "tfrecords"):
        done = export(read(spark, *[r for i, r in enumerate(GOOD) if i != 3], boxed), JOB, str(tmp_path / fmt), fmt, twice)
        assert (done.written.count(), done.rejects.count()) == (14, 0)


def test_archives_without_assets_are_refused(spark, tmp_path):
    done = export(read(spark, archive_record(1, "http://a/good")), JOB, str(tmp_path), "jsonl")
    assert done.written.count() == 0
    assert [r["reason"] for r in done.rejects.collect()] == ["missing_payload"]


def test_a_tar_that_ends_in_a_zip_is_a_tar(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x", "y")
    content = tar({**MEMBERS, "file_id.diz": manifest(*MEMBERS), "last.zip": inner.getvalue()}, "w")
    got = archives.unpack(spark.createDataFrame([(content,)], "content binary")).collect()
    assert {r["member"] for r in got} == {*MEMBERS, "last.zip"} and not any(r["error"] for r in got)


def test_a_damaged_archive_is_refused(spark):
    whole = tar({"file_id.diz": manifest("a", "b"), "a": b"1" * 5000, "b": bytes(range(256)) * 20})
    got = archives.unpack(spark.createDataFrame([(whole[: len(whole) * 2 // 3],)], "content binary")).collect()
    assert [r["error"] for r in got] == ["broken_archive"]


def test_assets_that_are_a_union_of_joins(spark, tmp_path):
    """Every asset listed twice, by joins and not from a table, where no side of a join is broadcast."""
    names = [md5(body(i)) + ".bin" for i in range(40)]
    held = spark.createDataFrame([(f"http://a/{i}", tar({names[i]: body(i), "file_id.diz": manifest(names[i])})) for i in range(40)], "url string, content binary")
    records = read(spark, *[archive_record(i, f"http://a/{i}") for i in range(40)])
    listed = records.select(F.col("entries")[0]["url"].alias("url")).filter("NOT url LIKE '%9'")
    held = held.join(listed, "url")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    try:
        done = export(records, JOB, str(tmp_path / "out"), "jsonl", held.unionByName(held))
        assert (done.written.count(), sorted(r["reason"] for r in done.rejects.collect())) == (36, ["missing_payload"] * 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_images_take_few_tasks(spark, tmp_path):
    """Files are packed into tasks by more than 32, all are read, and few files still keep all cores busy."""
    for i in range(1300):
        (tmp_path / f"{i}.png").write_bytes(b"no image")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        images = assets.read_images(spark, str(tmp_path))
        assert images.rdd.getNumPartitions() <= max(1300 // 8 + 1, 4 * spark.sparkContext.defaultParallelism) < 1300
        assert (images.count(), images.filter("ok").count(), images.select("origin").distinct().count()) == (1300, 0, 1300)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
