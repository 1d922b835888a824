"""Named queries over the test tables, each next to the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwright.functions.text import blob_path
from setwright.schema import ENTRY
from setwright.sources.job import Field, Job

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the test tables as a feed -------------------------------------------------

PAGE = 256
SPLITS = {"train": 70, "test": 20, "validate": 10}
FIELDS = (Field(0, 10, "source_file"), Field(1, 11, "label"), Field(2, 12, "size"), Field(3, 13, "body"))
JOB = Job(count=0, name="documents", fields=FIELDS, splits=SPLITS)

SET_SQL = """CASE WHEN {k} % 10 < 7 THEN 'train' WHEN {k} % 10 < 9 THEN 'test' ELSE 'validate' END"""

D_SQL = f"""
D AS (
  SELECT *, doc_id AS seq, md5(CAST(doc_id AS VARCHAR)) AS api_hash,
         {SET_SQL.format(k='doc_id')} AS "set", md5(text) || '.txt' AS fname
  FROM documents),
B AS (
  SELECT *, 'data/' || substr(fname, 1, 1) || '/' || substr(fname, 2, 1) || '/' || substr(fname, 3, 1)
         || '/' || fname AS blob
  FROM D),
N AS (SELECT * FROM B WHERE doc_id NOT IN (SELECT doc_id FROM labels))
"""


def set_of(key: str):
    return (
        F.when(F.col(key) % 10 < 7, "train").when(F.col(key) % 10 < 9, "test").otherwise("validate")
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed records, keyed by the hash of their id."""
    return table(spark, sf_dir, "documents").select(
        "*",
        F.col("doc_id").alias("seq"),
        F.md5(F.col("doc_id").cast("string")).alias("api_hash"),
        set_of("doc_id").alias("set"),
        F.concat(F.md5("text"), F.lit(".txt")).alias("fname"),
    )


def ledger_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as the records exported before."""
    ids = table(spark, sf_dir, "labels").select("doc_id")
    return ids.select("doc_id", F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("api_hash"))


def entry_struct(id_: int, kind: str, **members):
    """One typed entry, as the feed parser gives it."""
    names = {"id": F.lit(id_), "type": F.lit(kind), **members}
    types = dict(part.split(":", 1) for part in _top_level(ENTRY[len("struct<") : -1]))
    return F.struct(
        *[names.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]
    )


def _top_level(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [*parts, text[start:].strip()]


def with_entries(d: DataFrame) -> DataFrame:
    """Document records with three entries: the blob, its label, its size."""
    return d.withColumn(
        "entries",
        F.array(
            entry_struct(0, "raw", dtype=F.lit("uint8"), filename=F.col("fname"), digest=F.md5("text"),
                         n_bytes=F.octet_length("text")),
            entry_struct(1, "string", string_value=F.col("lang")),
            entry_struct(2, "numeric", dtype=F.lit("int"), int_value=F.col("n_chars")),
        ),
    ).withColumn("reason", F.lit(None).cast("string"))


def doc_blob():
    return blob_path("fname")
