"""Joins, numbering, means and the ledger against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from setwright.operators import joins, mean, numbering
from setwright.operators.ledger import Ledger, first_per_key, new_records, reconcile, verify_feed


@pytest.fixture
def skewed(spark):
    """A third of the rows share one key, some have none."""
    r = random.Random(1)
    keys = [None if i % 17 == 0 else "hot" if i % 3 == 0 else f"k{r.randrange(50)}" for i in range(3000)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string")
    right = spark.createDataFrame([(f"k{i}", i) for i in range(0, 50, 2)] + [("hot", -1)], "k string, v int")
    return left, right


def test_lookup_join_checks_the_size(skewed, rows, monkeypatch):
    left, right = skewed
    want = rows(left.join(right, "k", "left"))
    assert rows(joins.lookup_join(left, right, ["k"])) == want
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    assert rows(joins.lookup_join(left, right, ["k"])) == want
    monkeypatch.undo()
    assert joins.fits_broadcast(right)
    assert not joins.fits_broadcast(right, rows=10)
    assert not joins.fits_broadcast(right, size=100)


def test_lookup_join_of_null(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, v int")
    got = joins.lookup_join(left, right, ["k"], null_safe=True)
    assert got.columns == ["id", "k", "v"] and rows(got) == [(1, "a", 10), (2, None, 20), (3, "b", None)]


@pytest.mark.parametrize("bits", [27, 16])
def test_needed_only_keeps_what_is_asked_for(spark, rows, monkeypatch, bits):
    monkeypatch.setattr(joins, "KEY_BITS", bits)
    wide = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(b"x").alias("content"))
    keys = spark.range(0, 5000, 50).select(F.concat(F.lit("u"), "id").alias("url")).union(spark.createDataFrame([(None,)], "url string"))
    kept = joins.needed_only(wide, keys, ["url"])
    assert kept.columns == wide.columns and 100 <= kept.count() < 500
    assert kept.join(keys, "url").count() == 100
    assert "Exchange hashpartitioning(url" not in kept._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_partitions(monkeypatch):
    monkeypatch.setattr(numbering, "ROWS_PER_PARTITION", 100)


def test_positions_over_many_partitions(spark, many_partitions):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = numbering.row_positions(df, ["k"])
    assert numbering.in_order(df, ["k"]).select("_part").distinct().count() > 2
    assert got.filter("k <> position").count() == 0 and got.count() == 1000
    wide = df.select(F.when(F.col("k") > 0, F.col("k")).alias("k"), F.col("k").alias("v"))
    placed = numbering.row_positions(wide, ["k"])  # the NULL key comes first and keeps its row
    assert placed.columns == ["k", "v", "position"]
    assert placed.filter("v <> position").count() == 0 and placed.count() == 1000


def test_group_positions_and_totals_with_a_hot_group(spark, many_partitions):
    data = [("hot" if i % 10 else f"g{i % 7}", i, i % 5) for i in range(1500)]
    df = spark.createDataFrame(data, "g string, k int, b long")
    seen, total, want = {}, {}, set()
    for g, k, b in data:
        want.add((g, k, seen.get(g, 0), total.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
        total[g] = total.get(g, 0) + b
    place = numbering.group_positions(df, "g", ["k"]).select("g", "k", "position")
    before = numbering.running_totals(df, "g", ["k"], "b").select("g", "k", "total_before")
    got = {tuple(r) for r in place.join(before, ["g", "k"]).collect()}
    assert got == want


def test_null_groups_signs_and_halves(spark, many_partitions):
    """The same answers over many partitions as a plain loop gives."""
    data = [(None if i % 3 else f"g{i % 2}", i, (i % 7 - 3) * 0.5) for i in range(900)]
    df = spark.createDataFrame(data, "g string, k int, b double")
    seen, total, want = {}, {}, set()
    for g, k, b in data:
        want.add((k, seen.get(g, 0), total.get(g, 0.0)))
        seen[g] = seen.get(g, 0) + 1
        total[g] = total.get(g, 0.0) + b
    place = numbering.group_positions(df, "g", ["k"]).select("k", "position")
    before = numbering.running_totals(df, "g", ["k"], "b").select("k", "total_before")
    assert {tuple(r) for r in place.join(before, "k").collect()} == want


def test_dense_ids_in_order_of_appearance(spark, many_partitions):
    r = random.Random(2)
    labels = [f"l{r.randrange(400)}" for _ in range(2000)]
    df = spark.createDataFrame([(i // 100, i % 100, v) for i, v in enumerate(labels)], "page int, pos int, label string")
    got = {r["label"]: r["category_id"] for r in numbering.dense_ids(df, "label", ["page", "pos"], start=5).collect()}
    assert got == {v: i + 5 for i, v in enumerate(dict.fromkeys(labels))}


def test_first_per_key_and_new_records(spark, rows):
    df = spark.createDataFrame([("ab", 2, "b"), ("ab", 1, "a"), ("cd", 3, "c")], "api_hash string, seq int, v string")
    assert rows(first_per_key(df, "api_hash", "seq")) == [("ab", 1, "a"), ("cd", 3, "c")]
    known = spark.createDataFrame([(bytes.fromhex("cd"),)], "api_hash binary")
    assert rows(new_records(df, known)) == [("ab", 1, "a"), ("ab", 2, "b")]


def test_reconcile_counts_repeats(spark):
    f = spark.createDataFrame([("a",), ("a",), ("b",)], "api_hash string")
    held = spark.createDataFrame([("a",), ("c",)], "api_hash string")
    assert {r["api_hash"]: r["status"] for r in reconcile(f, held).collect()} == {
        "a": "both", "b": "feed_only", "c": "ledger_only",
    }
    assert verify_feed(f, held).first() == (2, 1, 1)


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    with pytest.raises(FileNotFoundError):
        Ledger.open(spark, path)
    ledger = Ledger.create(spark, path, "demo")
    assert ledger.hashes().count() == 0
    assert (ledger.get_metadata("name"), ledger.get_metadata("nope")) == ("demo", None)
    schema = "file_id int, api_hash string, record_hash string, member_pos long, seq int"
    one = spark.createDataFrame([(1, "ab", "01", 0, 5), (1, "ab", "02", 0, 4), (1, "ab", "03", 1, 6)], schema)
    for _ in range(2):  # written again, it replaces itself
        ledger.append_hashes(one, "0")
        assert sorted((r["record_hash"].hex(), r["member_pos"]) for r in ledger.hashes().collect()) == [("02", 0), ("03", 1)]
    ledger.append_hashes(spark.createDataFrame([(1, "ab", "09", 0, 7), (1, "cd", "04", 0, 8)], schema), "1")
    assert sorted(r["record_hash"].hex() for r in ledger.hashes().collect()) == ["02", "03", "04"]
    names = spark.createDataFrame([("b.txt", 2), ("a.txt", 1)], "file_name string, seq int")
    ledger.register_files(names, ["seq"], "0")
    more = spark.createDataFrame([("b.txt", 2), ("c.txt", 1)], "file_name string, seq int")
    files = {r["file_name"]: r["file_id"] for r in ledger.register_files(more, ["seq"], "1").collect()}
    assert files == {"a.txt": 1, "b.txt": 2, "c.txt": 3}
    Ledger.create(spark, path, "again")
    assert ledger.hashes().count() == 0 and ledger.file_names().count() == 0


IMAGES = [[0.0, 10.0, 2.0, 30.0], [4.0, 50.0, 6.0, 70.0]]


@pytest.fixture
def images(spark):
    return spark.createDataFrame(list(enumerate(IMAGES)), "id int, v array<float>")


def test_means(images, rows):
    assert rows(mean.image_mean(images, "v", "global")) == [(21.5,)]
    assert rows(mean.image_mean(images, "v", "channel", 2)) == [(0, 3.0), (1, 40.0)]
    assert rows(mean.image_mean(images, "v", "pixel")) == [(0, 2.0), (1, 30.0), (2, 4.0), (3, 50.0)]
    assert rows(mean.image_channel_means(images, "v", 2)) == [(0, 0, 1.0), (0, 1, 20.0), (1, 0, 5.0), (1, 1, 60.0)]


@pytest.mark.parametrize("kind, at", [("global", None), ("channel", lambda i: i % 2), ("pixel", lambda i: i)])
def test_subtract_mean(images, kind, at):
    m = mean.image_mean(images, "v", kind, 2)
    values = [r[-1] for r in sorted(m.collect())]
    got = [r["v"] for r in mean.subtract_mean(images, "v", m, kind, 2).orderBy("id").collect()]
    assert got == [[x - (values[at(i)] if at else values[0]) for i, x in enumerate(v)] for v in IMAGES]


def test_dim_check(spark):
    df = spark.createDataFrame([(1, 4, 3), (0, 2, 3), (2, 2, 3), (3, 2, 1)], "id int, width int, channels int")
    got = {r["id"]: r["ok"] for r in mean.with_dim_check(df, ["width", "channels"], "id").collect()}
    assert got == {0: True, 1: False, 2: True, 3: False}


def test_sampled_mean_is_near(spark):
    df = spark.range(4000).select(F.array((F.col("id") % 100).cast("float")).alias("v"))
    exact = mean.image_mean(df, "v", "global").first()["m"]
    sampled = mean.sampled_mean(df, "v", "global", pages=3, size=256, seed=1).first()["m"]
    # Six standard errors of 768 draws of a value spread evenly over 0 to 99.
    assert abs(sampled - exact) < 6 * 29 / 768**0.5


@pytest.mark.parametrize("fmt", ["csv", "parquet", "raw"])
def test_save_mean(spark, images, tmp_path, fmt):
    m = mean.image_mean(images, "v", "pixel")
    path = str(tmp_path / fmt)
    mean.save_mean(m, path, fmt)
    if fmt == "raw":
        import numpy as np

        raw = spark.read.parquet(path).first()["mean"]
        assert np.frombuffer(bytes(raw), "<f4").tolist() == [2.0, 30.0, 4.0, 50.0]
    else:
        back = spark.read.format(fmt).option("header", True).load(path)
        assert sorted((int(r["i"]), float(r["m"])) for r in back.collect())[1] == (1, 30.0)


def test_ties_do_not_multiply_rows(spark, many_partitions):
    rows = [(k // 3, k, "a" if k % 2 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, v int, g string")
    placed = numbering.row_positions(df.select("k", "v"), ["k"]).collect()
    assert sorted(r["position"] for r in placed) == list(range(60)) and len({r["v"] for r in placed}) == 60
    assert [r["k"] for r in sorted(placed, key=lambda r: r["position"])] == [k // 3 for k in range(60)]
    totals = numbering.running_totals(df, "g", ["k"], "k").collect()
    assert len(totals) == 60
    assert sorted(r["position"] for r in numbering.group_positions(df, "g", ["k"]).collect()) == sorted([*range(30), *range(30)])


@pytest.mark.parametrize("limit", [1, 7, 40, 10_000])
def test_greedy_shards(spark, many_partitions, limit):
    """Shards over many ranges, longer and shorter than one, with empty rows, a huge one and ties."""
    import random

    from setwright.operators.shards import greedy_shards

    rng = random.Random(limit)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k // 2, k, rng.choice([0, 0, 1, 2, 3, 5, None, 500 if rng.random() < 0.02 else 4])) for k in range(400)]
    rows.append(("only", 0, 1000, 0))
    df = spark.createDataFrame(rows, "g string, k int, id int, b bigint").repartition(3)
    got = {r["id"]: r["shard"] for r in greedy_shards(df, "g", ["k", "id"], "b", limit).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        shard, held = 0, 0
        for _, _, i, b in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            if held >= limit:
                shard, held = shard + 1, 0
            want[i], held = shard, held + (b or 0)
    assert got == want
    assert greedy_shards(df.limit(0), "g", ["k", "id"], "b", limit).count() == 0


def test_ranges_follow_the_bytes(spark, monkeypatch):
    """Few rows with long values are sorted by many tasks, and numbered the same."""
    monkeypatch.setattr(numbering, "BYTES_PER_PARTITION", 20_000, raising=False)
    df = spark.range(200).select((199 - F.col("id")).alias("id"), F.repeat(F.lit("x"), 500).alias("text"), F.array("id").alias("a"), F.struct("id").alias("s"))
    ordered = numbering.in_order(df, ["id"])
    assert ordered.select("_part").distinct().count() >= 4
    assert numbering.row_positions(df, ["id"]).filter("position <> id").isEmpty()
    nothing = df.withColumn("text", F.lit(None).cast("string"))
    assert numbering.row_positions(nothing.limit(0), ["id"]).count() == 0
    assert numbering.row_positions(nothing, ["id"]).filter("position <> id").isEmpty()
