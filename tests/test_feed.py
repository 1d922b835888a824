"""Job documents and feed pages, good and bad."""

import json

import pytest
from pyspark.sql import functions as F

from setwright.sources import feed, job
from setwright.sources.job import Field

JOB = {
    "count": 1000,
    "dataset": {"id": 1, "name": "demo", "description": "..."},
    "mapping": [{"id": 0, "name": "source", "fieldid": 10}, {"id": 1, "name": "label", "fieldid": 11}],
    "splits": {"train": 70, "test": 20, "validate": 10},
    "other": True,
}
FIELDS = (Field(0, 10, "source"), Field(1, 11, "label"), Field(2, 12, "n"), Field(3, 13, "score"))

GOOD = {
    "set": "train",
    "hash": "9e107d9d372bb6826bd81d3542a419d6",
    "data": [
        {"type": "image", "dtype": "jpeg", "fieldid": 10, "url": "http://h/a.jpg"},
        {"type": "string", "fieldid": 11, "value": "cat", "tags": ["x", "y"], "note": "[z"},
        {"type": "numeric", "dtype": "int", "id": 2, "value": 5},
        {"type": "numeric", "dtype": "float", "name": "score", "value": 0.25},
        {"type": "archive", "url": "http://h/more.tar.gz"},
    ],
}


def pages(spark, *bodies):
    texts = [(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(texts, "page int, body string")


def test_job_document(spark, tmp_path):
    (tmp_path / "job.json").write_text(json.dumps(JOB, indent=1))
    loaded = job.load_job(spark, str(tmp_path))
    assert loaded.count == 1000 and loaded.name == "demo"
    assert loaded.fields == (Field(0, 10, "source"), Field(1, 11, "label"))
    assert loaded.splits == {"train": 70, "test": 20, "validate": 10}
    fields = job.fields(job.read_jobs(spark, str(tmp_path))).collect()
    assert [(f["pos"], f["id"], f["name"]) for f in fields] == [(0, 0, "source"), (1, 1, "label")]


@pytest.mark.parametrize("part", job.REQUIRED)
def test_job_document_lacks_a_part(spark, tmp_path, part):
    (tmp_path / "job.json").write_text(json.dumps({k: v for k, v in JOB.items() if k != part}))
    with pytest.raises(Exception, match=f"incomplete job document: {part}"):
        job.load_job(spark, str(tmp_path))


def test_good_record(spark):
    (record,) = feed.read_feed(pages(spark, [GOOD]), FIELDS).collect()
    assert (record["set"], record["api_hash"], record["pos"], record["reason"]) == ("train", GOOD["hash"], 0, None)
    image, label, n, score, archive = record["entries"]
    assert (image["id"], image["type"], image["url"]) == (0, "image", "http://h/a.jpg")
    assert image["filename"].endswith(".jpg") and len(image["filename"]) == 36
    assert (label["id"], label["string_value"], label["optional"]) == (1, "cat", {"tags": ["x", "y"]})
    assert (n["id"], n["int_value"]) == (2, 5)
    assert (score["id"], score["float_value"], score["field_name"]) == (3, 0.25, "score")
    assert (archive["id"], archive["type"]) == (None, "archive")


def test_bad_pages(spark):
    given = pages(spark, {"a": 1}, [1], "[] x", "", None, "[", "[[]]", [], [{**GOOD, "x": 1}, GOOD], [GOOD, GOOD])
    status = {r["page"]: r["reason"] for r in feed.page_status(given).collect()}
    no_array, no_object = "not_an_array", "not_an_object"
    assert status == {
        0: no_array, 1: no_object, 2: no_array, 3: no_array, 4: no_array, 5: no_array, 6: no_object,
        7: None, 8: "unknown_key", 9: None,
    }
    strict = feed.read_feed(given, FIELDS)
    assert feed.accepted(strict).groupBy("page").count().collect() == [(9, 2)]
    lenient = feed.accepted(feed.read_feed(given, FIELDS, strict="record"))
    assert sorted(r["page"] for r in lenient.collect()) == [8, 9, 9]
    assert {r["page"] for r in feed.rejected(strict).collect()} == {0, 1, 2, 3, 4, 5, 6, 8}


@pytest.mark.parametrize(
    "entry, reason",
    [
        ({"id": 1, "value": "x"}, "missing_type"),
        ({"type": 5, "id": 1}, "missing_type"),
        (7, "missing_type"),
        ({"type": "string", "fieldid": 99, "value": "x"}, "unknown_field"),
        ({"type": "string", "name": "nope", "value": "x"}, "unknown_field"),
        ({"type": "numeric", "id": 2, "value": 5}, "missing_dtype"),
        ({"type": "numeric", "dtype": "double", "id": 2, "value": 5}, "bad_dtype"),
        ({"type": "numeric", "dtype": "int", "id": 2, "value": 5.5}, "bad_value"),
        ({"type": "numeric", "dtype": "int", "id": 2, "value": 2**40}, "bad_value"),
        ({"type": "numeric", "dtype": "float", "id": 2, "value": "5"}, "bad_value"),
        ({"type": "image", "id": 0, "value": "x"}, "value_on_blob"),
        ({"type": "string", "value": "x"}, "no_output_id"),
        ({"type": "string", "id": 1, "url": "http://h/x"}, "url_on_scalar"),
        ({"type": "numeric", "id": 2}, None),
        ({"type": "string", "id": 1, "value": 5}, None),
        ({"type": "archive", "url": "http://h/x"}, None),
    ],
)
def test_entry_reasons(spark, entry, reason):
    (record,) = feed.read_feed(pages(spark, [{"set": "train", "hash": "ab", "data": [entry]}]), FIELDS).collect()
    assert record["reason"] == reason


def test_string_entry_with_a_number_stays_empty(spark):
    entry = {"type": "string", "id": 1, "value": 5}
    (record,) = feed.read_feed(pages(spark, [{"set": "s", "hash": "ab", "data": [entry]}]), FIELDS).collect()
    assert record["entries"][0]["string_value"] is None


def test_pages_by_file_and_by_line(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"page{i}.json").write_text(json.dumps([GOOD, GOOD], indent=1))
    whole = feed.read_feed(feed.read_pages(spark, str(tmp_path)), FIELDS)
    assert whole.count() == 6 and whole.select("page_file").distinct().count() == 3
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "pages.txt").write_text("\n".join(json.dumps([GOOD]) for _ in range(4)))
    assert feed.read_feed(feed.read_pages(spark, str(lines), "line"), FIELDS).count() == 4


def test_random_sample_is_exact(spark):
    df = spark.range(1000)
    assert feed.random_sample(df, 256).distinct().count() == 256
    assert feed.random_sample(df, 5000).count() == 1000


def test_page_plan(spark):
    plan = feed.page_plan(F.lit(600), 256, F.lit("f?n=$BATCHSIZE&o=$OFFSET&i=$ITERATION"), F.lit(1))
    (row,) = spark.range(1).select(plan.alias("p")).collect()
    assert [p["url"] for p in row["p"]] == [f"f?n=256&o={o}&i=1" for o in (0, 256, 512)]
    (none,) = spark.range(1).select(feed.page_plan(F.lit(0), 256, F.lit("x"), F.lit(0)).alias("p")).collect()
    assert none["p"] == []


def test_a_repeated_key_is_read(spark):
    text = '[{"set":"a","set":"train","hash":"h","data":[{"type":"raw","type":"string","id":1,"value":"x","value":"y"}]},{"set":"test","hash":"i","data":[]}]'
    got = feed.read_feed(spark.createDataFrame([(0, text)], "page int, body string"), FIELDS).orderBy("pos").collect()
    assert [(r["set"], r["reason"]) for r in got] == [("train", None), ("test", None)]
    assert got[0]["entries"][0]["string_value"] == "y"


@pytest.mark.parametrize("size", [21_000_000, 135_000_000])
def test_a_value_too_large_refuses_its_own_record_only(spark, size):
    """Values of over 20 million characters are read; a record over 128 MiB is refused, and only that."""
    record = lambda value: F.concat(F.lit('{"set":"train","hash":"h","data":[{"type":"string","id":1,"value":"'), value, F.lit('"}]}'))
    body = F.concat(F.lit("["), record(F.lit("a")), F.lit(","), record(F.repeat(F.lit("x"), F.lit(size))), F.lit(","), record(F.lit("b")), F.lit("]"))
    pages = spark.range(1).select(F.col("id").alias("page"), body.alias("body"))
    value = F.get("entries", F.lit(0))["string_value"]
    got = feed.read_feed(pages, FIELDS).select("pos", "reason", F.left(value, F.lit(1)).alias("v"), F.length(value).alias("n")).orderBy("pos").collect()
    middle = (None, "x", size) if size < 1 << 27 else ("unreadable_record", None, None)
    assert [(r["reason"], r["v"], r["n"]) for r in got] == [(None, "a", 1), middle, (None, "b", 1)]


def test_a_string_that_holds_a_record_is_no_record(spark):
    page = json.dumps([GOOD, json.dumps(GOOD)])
    for strict, reasons in (("page", ["not_an_object"] * 2), ("record", [None, "not_an_object"])):
        got = feed.read_feed(spark.createDataFrame([(0, page)], "page int, body string"), FIELDS, strict).orderBy("pos").collect()
        assert [r["reason"] for r in got] == reasons
