"""Array files cut into records, whatever their splits."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_feed import FIELDS, GOOD

from setwright.sources import feed
from setwright.sources.arrays import array_records


def texts(seed, n):
    rng = random.Random(seed)
    pieces = ['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "日", " ", "\n", "\\\"", "}}", "]]"]
    value = lambda d: rng.choice([
        rng.random(), None, True, "".join(rng.choices(pieces, k=rng.randrange(12))), [value(d - 1) for _ in range(rng.randrange(3))] if d else 1,
        {"".join(rng.choices(pieces, k=2)): value(d - 1) for _ in range(rng.randrange(3))} if d else "}",
    ])
    return [value(3) for _ in range(n)]


@pytest.mark.parametrize("split", [16, 100, 1 << 20])
def test_records_of_any_split(spark, tmp_path, split):
    files = {f"f{k}.json": texts(k, k * 13 % 50) for k in range(5)}
    for k, (name, values) in enumerate(files.items()):
        (tmp_path / name).write_text(json.dumps(values, indent=[None, 1][k % 2], ensure_ascii=bool(k % 3)), encoding="utf-8")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = array_records(spark, str(tmp_path)).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    for name, values in files.items():
        mine = sorted((r["start"], r["n"], r["body"]) for r in rows if r["page_file"].endswith(name))
        assert [json.loads(b) for _, _, b in mine] == [[v] for v in values]
    if split == 16:
        assert len({r["start"] for r in rows}) > 10


def test_defects_outside_and_between(spark, tmp_path):
    cases = {"a": '[{"x":1}] tail', "b": 'lead [1]', "c": "[1,,2]", "d": "", "e": " [ ] ", "f": '{"a":1}', "g": "[[1],[2]]", "h": "[1]\n"}
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {}
    for r in sorted(array_records(spark, str(tmp_path)).collect()):
        got.setdefault(r["page_file"][-6], []).append(r["body"])
    assert got.get("c") == ["[1]", "", "[2]"] and got.get("g") == ["[[1]]", "[[2]]"] and got.get("h") == ["[1]"]
    assert "d" not in got and "e" not in got
    assert got["a"][-1].strip() == "tail" and got["b"][0].strip() == "lead" and not got["f"][0].startswith("[")


def test_array_feed_equals_pages(spark, tmp_path):
    records = [{**GOOD, "hash": f"{k:032x}"} for k in range(30)]
    (tmp_path / "page.json").write_text(json.dumps(records, indent=1))
    one = feed.read_feed(feed.read_pages(spark, str(tmp_path)), FIELDS)
    many = feed.read_feed(array_records(spark, str(tmp_path)), FIELDS, strict="record")
    columns = ["api_hash", "set", F.to_json("entries").alias("e"), "reason"]
    assert sorted(map(tuple, one.select(*columns).collect())) == sorted(map(tuple, many.select(*columns).collect()))
