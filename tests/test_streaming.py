"""A stream equals its batch twin, also over a stop and a restart."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_export import FIELDS, JOB, record

from setwright.operators.ledger import Ledger
from setwright.plans.export import ledger_path, verify_local
from setwright.streaming import feed_stream as fs


def land(folder, name, *records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(list(records)))


def scalar(i):
    r = record(i)
    return {**r, "data": r["data"][1:]}


def test_stream_export_over_a_restart(spark, tmp_path):
    landing, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    land(landing, "a.json", scalar(1), scalar(2))
    land(landing, "b.json", scalar(3), scalar(2), {**scalar(9), "hash": "abc"})
    pages = fs.page_stream(spark, str(landing), files_per_batch=1)
    fs.export_stream(pages, JOB, out, "jsonl", checkpoint)
    land(landing, "c.json", scalar(4), scalar(1))
    fs.export_stream(pages, JOB, out, "jsonl", checkpoint)
    fs.export_stream(pages, JOB, out, "jsonl", checkpoint)  # nothing new
    ledger = Ledger.open(spark, ledger_path(out))
    held = {bytes(r["api_hash"]).hex() for r in ledger.hashes().collect()}
    assert held == {record(i)["hash"] for i in (1, 2, 3, 4)}
    assert verify_local(spark, out, "jsonl").first() == (4, 0)
    assert FIELDS == JOB.fields


def test_streams_and_batches_into_one_place(spark, tmp_path):
    """New checkpoints and batches before them replace nothing."""
    out = str(tmp_path / "out")
    for n, name in enumerate("ab"):
        land(tmp_path / f"in{name}", "x.json", scalar(2 * n + 1), scalar(2 * n + 2))
        pages = fs.page_stream(spark, str(tmp_path / f"in{name}"))
        fs.export_stream(pages, JOB, out, "jsonl", str(tmp_path / f"ck{name}"))
    assert verify_local(spark, out, "jsonl").first() == (4, 0)


def test_dedupe_over_batches_and_restart(spark, tmp_path, rows):
    landing, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    rows_of = lambda lo, hi: spark.range(lo, hi, 1, 2).select((F.col("id") % 30).alias("k"), "id")
    rows_of(0, 40).write.parquet(landing)
    stream = fs.table_stream(spark, landing, "k long, id long", files_per_batch=1)
    fs.dedupe_stream(stream, "k", "id", target, checkpoint)
    rows_of(20, 90).write.mode("append").parquet(landing)
    fs.dedupe_stream(stream, "k", "id", target, checkpoint)
    assert rows(spark.read.parquet(target).select("k")) == sorted(((k,) for k in range(30)), key=repr)


def test_online_mean_is_the_mean(spark, tmp_path, rows):
    landing, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    images = lambda lo, hi: spark.range(lo, hi, 1, 2).select(
        F.array(F.col("id"), F.col("id") * 2).cast("array<float>").alias("v")
    )
    images(0, 10).write.parquet(landing)
    stream = fs.table_stream(spark, landing, "v array<float>", files_per_batch=1)
    fs.mean_stream(stream, "v", "channel", 2, target, checkpoint)
    assert rows(spark.read.parquet(target)) == [(0, 4.5), (1, 9.0)]
    images(10, 20).write.mode("append").parquet(landing)
    fs.mean_stream(stream, "v", "channel", 2, target, checkpoint)
    assert rows(spark.read.parquet(target)) == [(0, 9.5), (1, 19.0)]


def test_export_stops_between_batches(spark, tmp_path):
    """After so many micro-batches the stream ends; the next run goes on there and nothing is written twice."""
    landing, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    for k in range(4):
        land(landing, f"{k}.json", scalar(2 * k + 1), scalar(2 * k + 2))
    pages = fs.page_stream(spark, str(landing), files_per_batch=1)
    first = fs.export_stream(pages, JOB, out, "jsonl", checkpoint, stop_after=2)
    assert not first.query.isActive and verify_local(spark, out, "jsonl").first() == (4, 0)
    second = fs.export_stream(pages, JOB, out, "jsonl", checkpoint, wait=False)
    second.finish()
    found, lost = verify_local(spark, out, "jsonl").first()
    assert not second.query.isActive and found in (4, 6, 8) and lost == 0
    fs.export_stream(pages, JOB, out, "jsonl", checkpoint)
    assert verify_local(spark, out, "jsonl").first() == (8, 0)
    assert Ledger.open(spark, ledger_path(out)).hashes().count() == 8


def test_errors_of_a_batch_are_raised(spark, tmp_path):
    landing = tmp_path / "in"
    land(landing, "a.json", scalar(1))

    def fail(rows, batch_id):
        raise ValueError("no")

    with pytest.raises(StreamingQueryException):
        fs.run_available(fs.page_stream(spark, str(landing)), fail, str(tmp_path / "ck"))


@pytest.mark.parametrize("kind,want", [("global", [2.5]), ("channel", [2.0, 3.0]), ("pixel", [2.0, 3.0])])
def test_mean_streams(spark, tmp_path, kind, want):
    landing, target = str(tmp_path / "in"), str(tmp_path / "mean")
    spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "t array<float>").repartition(2).write.parquet(landing)
    stream = fs.table_stream(spark, landing, "t array<float>", files_per_batch=1)
    fs.mean_stream(stream, "t", kind, 2, target, str(tmp_path / "ck"))
    assert sorted(r["m"] for r in spark.read.parquet(target).collect()) == want
