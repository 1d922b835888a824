"""Every query against its SQL at the smallest scale, and the shape of the plans."""

import re

import pytest
from check_oracles import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as contract
from catalog import all_queries
from catalog.registry import FIELDS, docs, ledger_hashes
from setwright.operators.ledger import new_records
from setwright.operators.numbering import dense_ids
from setwright.sources import feed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, name, SF) is None


def test_every_query_has_sql():
    assert set(all_queries.ORACLES) == set(all_queries.QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feed_parsing_does_not_shuffle(spark):
    pages = spark.createDataFrame([(0, "[]")], "page int, body string")
    assert "Exchange" not in plan(feed.read_feed(pages, FIELDS))


def test_scan_reads_only_what_is_needed(spark):
    df = contract.queries()["resume_new_only"](spark, SF)
    schemas = re.findall(r"ReadSchema: (\S+)", plan(df))
    assert schemas and all(s in ("struct<doc_id:bigint>",) for s in schemas)


def test_known_records_go_before_payloads(spark):
    """The anti-join stays below the payload join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = new_records(docs(spark, SF), ledger_hashes(spark, SF))
        payload = docs(spark, SF).select(F.col("seq").alias("s"), "text")
        text = plan(fresh.drop("text").join(payload, F.col("seq") == F.col("s"), "left"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.index("LeftOuter") < text.index("LeftAnti")


def test_large_numbering_has_no_single_task_sort(spark, monkeypatch):
    from setwright.operators import numbering

    monkeypatch.setattr(numbering, "ROWS_PER_PARTITION", 10)
    df = numbering.row_positions(docs(spark, SF).select("doc_id"), ["doc_id"])
    text = plan(df)
    # The only single-partition exchange is over one row per range partition.
    single = text[text.index("SinglePartition") :]
    assert text.count("SinglePartition") == 1 and "HashAggregate(keys=[_part" in single
    ids = dense_ids(docs(spark, SF).select("fname", "doc_id"), "fname", ["doc_id"])
    assert plan(ids).count("SinglePartition") == 1


@pytest.mark.parametrize("name", ["csv_lines", "csv_lines_numeric", "label_encode", "channel_mean", "first_per_hash"])
def test_hot_queries_stay_in_the_jvm(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(contract.queries()[name](spark, SF)))


def test_library_collects_only_bounded_things():
    """No rows are brought to the driver; single values come by first()."""
    import pathlib

    root = pathlib.Path(contract.ROOT) / "setwright"
    calls = {
        str(f.relative_to(root)) for f in root.rglob("*.py")
        if "llm" not in f.parts and re.search(r"\.(collect|toPandas|toLocalIterator)\(", f.read_text())
    }
    assert calls == set()
