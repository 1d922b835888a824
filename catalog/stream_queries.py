"""The streaming twins: tables landed as files, run to the end, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.feed_queries import as_pages, doc_json
from catalog.registry import D_SQL, JOB, docs, query, table, with_entries
from setwright.operators.ledger import Ledger
from setwright.plans.export import export, ledger_path, verify_local
from setwright.session import scratch_path
from setwright.streaming import feed_stream as fs

LANDED_FILES = 8


def _landed(df, label: str) -> tuple[str, object]:
    """Rows as a number of files, as a feed would drop them."""
    path = scratch_path(df.sparkSession, label)
    df.repartition(LANDED_FILES).write.parquet(path)
    return path, df.schema


def _dirs(spark, label: str) -> tuple[str, str]:
    return scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")


@query("stream_feed_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_feed_count(spark, sf_dir):
    path, schema = _landed(table(spark, sf_dir, "events").select("event_id", "event_type"), "events")
    target, checkpoint = _dirs(spark, "counts")
    fs.count_stream(fs.table_stream(spark, path, schema), "event_type", target, checkpoint)
    return spark.read.parquet(target)


@query(
    "stream_dedupe",
    "SELECT DISTINCT md5(event_type || CAST(user_id AS VARCHAR)) AS api_hash FROM events",
)
def stream_dedupe(spark, sf_dir):
    key = F.md5(F.concat("event_type", F.col("user_id").cast("string"))).alias("api_hash")
    path, schema = _landed(table(spark, sf_dir, "events").select(key, "event_id"), "keys")
    target, checkpoint = _dirs(spark, "deduped")
    fs.dedupe_stream(fs.table_stream(spark, path, schema), "api_hash", "event_id", target, checkpoint)
    return spark.read.parquet(target).select("api_hash")


def _stream_documents(spark, d, out: str, fmt: str, **options) -> None:
    """Land documents as pages and export them with a checkpoint of their own."""
    pages = as_pages(d.select("doc_id", doc_json().alias("json")), "doc_id")
    landing, checkpoint = _dirs(spark, "pages")
    pages.select("body").write.text(landing)
    stream = fs.page_stream(spark, landing, files_per_batch=4, one_page_per="line")
    fs.export_stream(stream, JOB, out, fmt, checkpoint, **options)


@query(
    "stream_after_batch",
    f"""WITH {D_SQL} SELECT count(*) AS found, CAST(0 AS BIGINT) AS not_found, count(DISTINCT api_hash) AS recorded FROM D""",
)
def stream_after_batch(spark, sf_dir):
    """A batch export, then two streams with new checkpoints into the same place: nothing is replaced."""
    d = docs(spark, sf_dir)
    out = scratch_path(spark, "mixed")
    export(with_entries(d.filter("doc_id % 3 = 0")), JOB, out, "jsonl")
    for part in (1, 2):
        _stream_documents(spark, d.filter(f"doc_id % 3 = {part}"), out, "jsonl")
    recorded = Ledger.open(spark, ledger_path(out)).hashes().agg(F.count_distinct("api_hash").alias("recorded"))
    return verify_local(spark, out, "jsonl").crossJoin(recorded)  # one row each


@query(
    "stream_export",
    f"""WITH {D_SQL} SELECT "set", count(*) AS n, count(DISTINCT lang || ' ' || CAST(n_chars AS VARCHAR) || ' ' || text) AS lines FROM D GROUP BY 1""",
)
def stream_export(spark, sf_dir):
    """Pages of documents landed as files and exported page by page as text."""
    out = scratch_path(spark, "streamed")
    _stream_documents(spark, docs(spark, sf_dir), out, "csv", escape=True)
    text = spark.read.schema("value string, batch string, set string").option("lineSep", "\n").text(f"{out}/lines")
    return text.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("lines"))


@query(
    "stream_channel_mean",
    """WITH V AS (SELECT unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT CAST(i % 4 AS BIGINT) AS ch, round(avg(v), 6) AS m FROM V GROUP BY 1""",
)
def stream_channel_mean(spark, sf_dir):
    path, schema = _landed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "tensors")
    target, checkpoint = _dirs(spark, "mean")
    fs.mean_stream(fs.table_stream(spark, path, schema), "embedding", "channel", 4, target, checkpoint)
    return spark.read.parquet(target).select(F.col("ch").cast("bigint").alias("ch"), F.round("m", 6).alias("m"))
