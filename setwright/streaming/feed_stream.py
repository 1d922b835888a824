"""The feed as a stream of landed pages, exported micro-batch by micro-batch."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from setwright.operators.ledger import Ledger, first_per_key
from setwright.operators.mean import mean_vector
from setwright.plans.export import export, ledger_path
from setwright.session import exists
from setwright.sources.feed import read_feed
from setwright.sources.job import Field, Job


def page_stream(spark: SparkSession, landing: str, files_per_batch: int = 4, one_page_per: str = "file") -> DataFrame:
    """Pages as they land, a bounded number of files per micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    text = reader.text(landing, wholetext=one_page_per == "file")
    return text.select(F.col("_metadata.file_path").alias("page_file"), F.col("value").alias("body"))


def table_stream(spark: SparkSession, landing: str, schema, files_per_batch: int = 4) -> DataFrame:
    """Parquet rows as they land."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    )


_STOPPED = "stopped between micro-batches"


class Running:
    """A stream that runs, and a way to end it between two micro-batches.

    A micro-batch that has begun is finished. The one after it is refused before it does anything, so the
    checkpoint still has it to do and the next run begins with it.
    """

    def __init__(self, on_batch: Callable[[DataFrame, int], None], stop_after: int | None = None):
        self._on_batch, self._left = on_batch, stop_after
        self._stop = threading.Event()
        self.query: StreamingQuery | None = None

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        if self._stop.is_set() or self._left == 0:
            raise RuntimeError(_STOPPED)
        if self._left is not None:
            self._left -= 1
        self._on_batch(rows, batch_id)

    def wait(self, seconds: float | None = None) -> bool:
        """Wait for the end of the stream; whether it has ended."""
        try:
            if seconds is None:
                self.query.awaitTermination()
                return True
            return bool(self.query.awaitTermination(max(1, round(seconds))))
        except StreamingQueryException as problem:
            if _STOPPED not in str(problem):
                raise
            return True

    def finish(self) -> None:
        """End the stream after the micro-batch that runs; at once if none does."""
        self._stop.set()
        while self.query.isActive:
            if not self.query.status["isTriggerActive"]:
                self.query.stop()
            elif self.wait(1):
                return

    def progress(self) -> list[tuple[int, int]]:
        """Number and input rows of the latest micro-batches."""
        return [(p["batchId"], p["numInputRows"]) for p in self.query.recentProgress]


def start_available(stream: DataFrame, on_batch, checkpoint: str, stop_after: int | None = None) -> Running:
    """Start to process all that has landed, or ``stop_after`` micro-batches of it."""
    running = Running(on_batch, stop_after)
    running.query = (
        stream.writeStream.foreachBatch(running.batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    return running


def run_available(stream: DataFrame, on_batch, checkpoint: str) -> StreamingQuery:
    """Process all that has landed and stop; the checkpoint remembers how far it got."""
    running = start_available(stream, on_batch, checkpoint)
    running.wait()
    return running.query


def record_stream(pages: DataFrame, mapping: Sequence[Field], strict: str = "page") -> DataFrame:
    """Typed records with a ``seq`` of page file and place."""
    return read_feed(pages, mapping, strict).withColumn("seq", F.struct("page_file", "pos"))


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to; made with the checkpoint and kept in it."""
    path = f"{checkpoint.rstrip('/')}/export-run"
    if not exists(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).first()["value"]


def export_stream(
    pages: DataFrame, job: Job, out: str, fmt: str, checkpoint: str, assets: DataFrame | None = None,
    wait: bool = True, stop_after: int | None = None, **options,
) -> Running:
    """Export each micro-batch as a batch of its own.

    Returns when all that has landed, or ``stop_after`` micro-batches of it, is exported; with ``wait=False`` at once, with
    the running stream, which ``finish()`` ends after its current micro-batch.

    The batch is named by the checkpoint's run id and the micro-batch, so a micro-batch that is run again replaces
    its own files and ledger rows, and no other run's: a restart neither loses nor doubles records.
    """
    spark = pages.sparkSession
    run = run_id(spark, checkpoint)
    try:
        Ledger.open(spark, ledger_path(out))
    except FileNotFoundError:
        Ledger.create(spark, ledger_path(out), job.name)

    def write(records: DataFrame, batch_id: int) -> None:
        if not records.isEmpty():
            export(records, job, out, fmt, assets, mode="resume", batch=f"{run}-{batch_id}", **options)

    running = start_available(record_stream(pages, job.fields), write, checkpoint, stop_after)
    if wait:
        running.wait()
    return running


def dedupe_stream(rows: DataFrame, key: str, seq: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the first row of each key over all micro-batches and runs.

    What was kept is the target table itself, so there is no growing state: a
    micro-batch is reduced to one row per key, compared with the other batches,
    and written to its own folder.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c != key]
    schema_text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        firsts = first_per_key(batch.select(key, *kept), key, seq)
        if batch_id > 0:
            earlier = spark.read.schema(f"{schema_text}, batch bigint").parquet(target)
            seen = earlier.filter(F.col("batch") != batch_id).select(key).distinct()
            firsts = firsts.join(seen, key, "left_anti")
        firsts.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return run_available(rows, write, checkpoint)


def mean_stream(
    images: DataFrame, tensor: str, kind: str, channels: int, target: str, checkpoint: str
) -> StreamingQuery:
    """Keep the mean over everything seen so far in ``target``, updated per micro-batch.

    The state is one sum and one count per channel or pixel.
    """
    if kind == "pixel":
        # Kept as one sum and one count per pixel in the state; vectors of partial sums would pile up there.
        pixels = images.select(F.posexplode(tensor).alias("i", "x"))
        means = pixels.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    else:
        means = mean_vector(images, tensor, kind, channels)
        at = {"global": [F.get("v", F.lit(0)).alias("m")], "channel": [F.posexplode("v").alias("ch", "m")]}[kind]
        means = means.select(*at)
    query = (
        means.writeStream.outputMode("complete")
        .foreachBatch(lambda m, _: m.write.mode("overwrite").parquet(target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def count_stream(rows: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the number of rows per key over everything seen so far in ``target``."""
    query = (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .writeStream.outputMode("complete")
        .foreachBatch(lambda m, _: m.write.mode("overwrite").parquet(target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
