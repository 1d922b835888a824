"""The job document: what a dataset holds and how its fields map to the output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwright import schema

REQUIRED = ("count", "dataset", "mapping", "splits")


def read_jobs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Job documents, one per file (or per line with ``multiline=False``)."""
    return spark.read.schema(schema.JOB).option("multiLine", multiline).json(path)


def require_complete(jobs: DataFrame) -> DataFrame:
    """Fail the query on a document that lacks a required part; other keys are ignored."""
    missing = F.concat_ws(
        ", ", *[F.when(F.col(part).isNull(), F.lit(part)) for part in REQUIRED]
    )
    incomplete = F.raise_error(F.concat(F.lit("incomplete job document: "), missing))
    return jobs.filter(F.when(missing == "", True).otherwise(incomplete.cast("boolean")))


def fields(jobs: DataFrame, *keep: str) -> DataFrame:
    """The output mapping, one row per field, in output column order."""
    return jobs.select(*keep, F.posexplode("mapping").alias("pos", "field")).select(
        *keep,
        "pos",
        F.col("field.id").alias("id"),
        F.col("field.fieldid").alias("field_id"),
        F.col("field.name").alias("name"),
    )


def splits(jobs: DataFrame, *keep: str) -> DataFrame:
    """The declared sets with their share in percent."""
    return jobs.select(*keep, F.explode("splits").alias("set", "declared_pct"))


@dataclass(frozen=True)
class Field:
    """One output field; its place in the mapping is the output column order."""

    id: int
    field_id: int | None
    name: str


@dataclass(frozen=True)
class Job:
    """The parts of one job document that shape a plan (column order, set names)."""

    count: int
    name: str
    fields: tuple[Field, ...]
    splits: dict[str, int]


def load_job(spark: SparkSession, path: str) -> Job:
    """Read the one job document at ``path``; its size does not grow with the data."""
    row = require_complete(read_jobs(spark, path)).first()
    if row is None:
        raise ValueError(f"no job document at {path}")
    return Job(
        count=row["count"],
        name=row["dataset"]["name"],
        fields=tuple(Field(m["id"], m["fieldid"], m["name"]) for m in row["mapping"]),
        splits=dict(row["splits"]),
    )
