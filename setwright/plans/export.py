"""The export: records to files, blobs and ledger rows, and the checks on them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwright.functions.text import blob_path, is_hash_text
from setwright.operators.entries import is_blob
from setwright.operators.joins import lookup_join, needed_only
from setwright.operators.ledger import Ledger, first_per_key, new_records, verify_feed, verify_records
from setwright.operators.mean import KINDS, save_mean
from setwright.plans.pixels import decode_images, subtract_from
from setwright.session import exists, plain_unions, staged
from setwright.sinks import blobfiles
from setwright.sinks.writers import WRITERS, Context, SetWriter
from setwright.sources.archives import expand_archives, holds_archive
from setwright.sources.assets import attach_payloads, name_defect, one_per_url, unopened_defect, with_reason
from setwright.sources.job import Job


@dataclass(frozen=True)
class Exported:
    """What one batch wrote: ``(set, api_hash, member_pos, record_hash, file_name)``, and what it refused."""

    written: DataFrame
    rejects: DataFrame


def ledger_path(out: str) -> str:
    return f"{out.rstrip('/')}/ledger"


def open_ledger(spark: SparkSession, out: str, name: str, mode: str) -> Ledger:
    """The ledger of an export: started anew with ``mode="new"``, loaded with ``mode="resume"``."""
    if mode == "new":
        return Ledger.create(spark, ledger_path(out), name)
    if mode == "resume":
        return Ledger.open(spark, ledger_path(out))
    raise ValueError("mode is 'new' or 'resume'")


def repeated(records: DataFrame, iterations: int) -> DataFrame:
    """Each record once per iteration, with ``iteration`` from 0; nothing is shuffled."""
    return records.withColumn(
        "iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))
    )


_RECORD = ("seq", "set", "api_hash", "entries", "reason")
_REJECT = ("seq", "set", "api_hash", "reason")


def _checked(records: DataFrame, job: Job) -> DataFrame:
    known = F.col("set").isin(*job.splits)
    defect = F.when(~is_hash_text("api_hash"), "bad_hash").when(
        ~F.coalesce(known, F.lit(False)), "unknown_set"
    )
    return records.withColumn("reason", F.coalesce("reason", defect)).withColumn(
        "api_hash", F.lower("api_hash")
    )


def _opened(records: DataFrame, assets: DataFrame, job: Job, keep_content: bool) -> DataFrame:
    """Records with archives replaced by their members; unpacked once and staged."""
    if records.filter(holds_archive()).isEmpty():
        return records.withColumn("member_pos", F.lit(0).cast("bigint"))
    return staged(expand_archives(records, assets, job.fields, keep_content), "opened")


def _with_payloads(records: DataFrame, assets: DataFrame | None, job: Job, keep_content: bool) -> DataFrame:
    """Records with archives opened and payloads attached, or checked if there are no assets."""
    if assets is None:
        placed = records.withColumn("member_pos", F.lit(0).cast("bigint"))
        return with_reason(placed, unopened_defect)
    return attach_payloads(_opened(records, assets, job, keep_content), assets, keep_content)


def _with_pixels(ready: DataFrame, subtract: str | None, mean_format: str | None, mean_path: str) -> DataFrame:
    """Records with decoded images, and with the mean subtracted from all raw entries if one is asked for."""
    decoded = decode_images(staged(ready, "payloads"))
    if subtract is None:
        return staged(decoded, "decoded")
    less, mean = subtract_from(staged(decoded, "decoded"), subtract)
    if mean_format is not None:
        save_mean(mean, mean_path, mean_format, subtract)
    return staged(less, "subtracted")


def _placed(accepted: DataFrame, writer: SetWriter, spark: SparkSession, out: str, batch: str) -> DataFrame:
    """Accepted records with the file that each one is in, as found in the files themselves.

    Equal records of a set share the first file that holds them. With ``integrity`` it is an error if any
    record cannot be read back.
    """
    if accepted.isEmpty():  # there are no files
        return accepted.select("seq", "set", "api_hash", "member_pos", "record_hash", F.lit(None).cast("string").alias("file_name"))
    receipts = writer.rescan(spark, out, batch).groupBy("set", "record_hash").agg(F.min("file_name").alias("file_name"))
    narrow = accepted.select("seq", "set", "api_hash", "member_pos", "record_hash")
    placed = staged(narrow.join(receipts, ["set", "record_hash"], "left"), "receipts")
    if writer.capabilities.integrity and not placed.filter(F.col("file_name").isNull()).isEmpty():
        raise RuntimeError(f"records of batch {batch} are not in the files written for it")
    return placed


def written_files(spark: SparkSession, out: str, fmt: str) -> DataFrame:
    """The shard index: ``set``, ``file_name`` and ``records`` of every file of an export that holds any."""
    found = WRITERS[fmt.lower()].rescan(spark, out.rstrip("/"))
    return found.groupBy("set", "file_name").agg(F.count(F.lit(1)).alias("records"))


def _accepted_blobs(records: DataFrame, accepted: DataFrame) -> DataFrame:
    """The blob entries of accepted records."""
    return (
        records.filter(F.col("reason").isNull())
        .join(accepted.select("seq", "member_pos"), ["seq", "member_pos"], "left_semi")
        .select(F.explode("entries").alias("e"))
        .filter(is_blob(F.col("e")))
        .select("e.filename", "e.url", "e.content")
    )


def _inline_blobs(records: DataFrame, accepted: DataFrame) -> DataFrame:
    """``(filename, content)`` of accepted records whose entries all hold their bytes."""
    return _accepted_blobs(records, accepted).select("filename", "content").dropDuplicates(["filename"])


def _write_blobs(blobs: DataFrame, out: str, tree: bool) -> None:
    """Each blob as a file under its name."""
    blobfiles.register(blobs.sparkSession)
    files = blobs.select(blob_path("filename", "", tree).alias("path"), "content")
    files.write.format("blobfiles").mode("append").save(out)


def _external_blobs(records: DataFrame, accepted: DataFrame, assets: DataFrame) -> DataFrame:
    """``(filename, content)`` of accepted records' blobs, each name once.

    Blobs that came out of archives are in the entries; the others are fetched
    by URL here, so that the record rows never carry them.
    """
    blobs = _accepted_blobs(records, accepted)
    inline = blobs.filter(F.col("content").isNotNull()).select("filename", "content")
    wanted = blobs.filter(F.col("content").isNull()).select("filename", "url").distinct()
    asked = one_per_url(needed_only(assets.select("url", "content"), wanted, ["url"]))
    fetched = wanted.join(asked, "url")
    # The name is the hash of the content, so any copy will do.
    return inline.unionByName(fetched.select("filename", "content")).dropDuplicates(["filename"])


def export(
    records: DataFrame,
    job: Job,
    out: str,
    fmt: str,
    assets: DataFrame | None = None,
    mode: str = "new",
    batch: str | None = None,
    name: str | None = None,
    blobs: str = "auto",
    tree: bool = True,
    escape: bool = False,
    iterations: int = 1,
    decode: bool = False,
    subtract: str | None = None,
    mean_format: str | None = None,
    **options,
) -> Exported:
    """Write one batch of records and its ledger rows.

    ``records`` has ``seq`` (unique, in arrival order), ``set``, ``api_hash``,
    ``entries`` and ``reason``, as ``read_feed`` gives them with a ``seq``.
    Known hashes are dropped before any payload is joined. Records that cannot
    be written come back in ``rejects``; none stops the batch. Repeating a batch
    by its name replaces its files and its ledger rows; without a name the batch
    is a new one and replaces nothing.

    ``decode`` writes the pixels of images in place of their encoded bytes. ``subtract`` (``global``,
    ``channel`` or ``pixel``) decodes images, takes the mean over all raw entries of the batch and writes the differences as
    float tensors; ``mean_format`` keeps that mean below ``out`` (see ``save_mean``). ``iterations`` writes
    every record so many times; copies of a record have one ledger row.
    """
    batch = batch or uuid.uuid4().hex
    writer = WRITERS[fmt.lower()]
    writer.check_options(options)
    if mode == "resume" and not writer.capabilities.resume:
        raise ValueError(f"{fmt} cannot be resumed")
    if blobs not in ("auto", "external"):
        raise ValueError("blobs is 'auto' or 'external'")
    if subtract is not None and subtract not in KINDS:
        raise ValueError(f"subtract is one of {KINDS}")
    if mean_format is not None and subtract is None:
        raise ValueError("mean_format needs subtract")
    if (decode or subtract) and assets is None:
        raise ValueError("decode and subtract need assets")
    spark, out = records.sparkSession, out.rstrip("/")
    plain_unions(spark)
    ledger = open_ledger(spark, out, name or job.name, mode)
    if mode == "new" and exists(spark, f"{out}/{writer.folder}"):
        writer.clear(spark, out)
    external = blobs == "external" or not writer.capabilities.blobs

    # Typed records are small beside their payloads: they are written once, so that
    # no later branch of the plan parses the feed again.
    checked = staged(_checked(records.select(*_RECORD), job), "records")
    bad = checked.filter(F.col("reason").isNotNull())
    good = checked.filter(F.col("reason").isNull())
    fresh = new_records(good, ledger.hashes(without_batch=batch))
    fresh = staged(first_per_key(fresh, "api_hash", "seq"), "fresh")
    changed = decode or subtract is not None
    ready = _with_payloads(fresh, assets, job, keep_content=not external or changed)
    if changed:
        ready = _with_pixels(ready, subtract, mean_format, f"{out}/mean")
    if external:
        ready = with_reason(ready, name_defect)

    encoded = staged(
        writer.encode(ready, Context(job, out, batch, ledger, tree, escape)), "encoded"
    )
    accepted = encoded.filter(F.col("reason").isNull())
    if external and changed:
        _write_blobs(_inline_blobs(ready, accepted), out, tree)
    elif external and assets is not None:
        kept = fresh.join(accepted.select("seq").distinct(), "seq", "left_semi")
        with_bytes = _opened(kept, assets, job, keep_content=True)
        _write_blobs(_external_blobs(with_bytes, accepted, assets), out, tree)
    writer.write(repeated(accepted, iterations).drop("iteration") if iterations > 1 else accepted, out, batch, options)
    placed = _placed(accepted, writer, spark, out, batch)
    names = placed.groupBy("file_name").agg(F.min(F.struct("seq", "member_pos")).alias("first"))
    files = ledger.register_files(names, ["first"], batch)
    with_id = lookup_join(placed, files, ["file_name"])
    ledger.append_hashes(with_id, batch)
    return Exported(
        placed.select("seq", "set", "api_hash", "member_pos", "record_hash", "file_name"),
        bad.select(*_REJECT).unionByName(
            encoded.filter(F.col("reason").isNotNull()).select(*_REJECT)
        ),
    )


def verify_local(spark: SparkSession, out: str, fmt: str) -> DataFrame:
    """Re-hash everything written and count what the ledger does and does not know."""
    ledger = Ledger.open(spark, ledger_path(out))
    hashes = ledger.hashes().select(F.lower(F.hex("record_hash")).alias("record_hash"))
    return verify_records(WRITERS[fmt.lower()].rescan(spark, out.rstrip("/")), hashes)


def verify_against_feed(records: DataFrame, out: str) -> DataFrame:
    """Count feed records found and not found in the ledger, and ledger hashes the feed lacks."""
    ledger = Ledger.open(records.sparkSession, ledger_path(out))
    hashes = ledger.hashes().select(F.lower(F.hex("api_hash")).alias("api_hash")).distinct()
    return verify_feed(records.select(F.lower("api_hash").alias("api_hash")), hashes)


def split_report(records: DataFrame, declared: DataFrame) -> DataFrame:
    """Per set the records, their share in percent, and the declared share."""
    counts = records.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(declared, "set", "left").select(
        "set", "n", (F.col("n") * 100.0 / total.scalar()).alias("actual_pct"), "declared_pct"
    )
