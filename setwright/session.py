"""Session helpers: the shared scratch area and small session defaults."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset
    (tests on one machine) is a temporary folder made and recorded, so that
    later calls agree. A non-local master without the setting is an error,
    because a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="setwright-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/setwright/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a table that survives executor loss, gives the
    optimizer real sizes, and pins values (such as partition numbers) that must
    not change if a task is run again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_unions(spark: SparkSession) -> None:
    """Unions put their parts one after the other and say nothing about where keys are.

    Spark 4.1 takes a union of parts that are dealt out by the same key to be dealt out by it, too, and joins or
    groups it where it is. Adaptive execution may then run the parts in another way: rows do not meet, or the job
    ends with "Can't zip RDDs with unequal numbers of partitions". Read when a plan is made, so it stays set.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored at ``path``, on whatever file system it names."""
    try:
        spark.read.schema("value string").text(path)
        return True
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
