"""The output formats: one record to one written row, its hash, and back.

A writer turns records into a frame with ``set``,
``record_hash``, a ``payload`` (what is written) and ``reason``; writes accepted
rows of one batch; and re-reads a batch or a whole export as ``(set, record_hash, file_name)``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setwright import schema
from setwright.functions.text import blob_path, float_text, int_text, join_fields, md5_hex
from setwright.operators.entries import cell_text, is_blob, last_of, last_with_id, output_line
from setwright.operators.joins import lookup_join
from setwright.operators.ledger import Ledger
from setwright.session import staged
from setwright.sinks import tfrecord
from setwright.sinks.example_proto import encode_example
from setwright.sources.job import Job


@dataclass(frozen=True)
class Capabilities:
    resume: bool
    integrity: bool
    blobs: bool


@dataclass(frozen=True)
class Context:
    """What a writer may need to know to encode the records of a batch."""

    job: Job
    root: str
    batch: str
    ledger: Ledger
    tree: bool = True
    escape: bool = False


class SetWriter(ABC):
    """A format. Subclass it and add an instance to ``WRITERS`` for a new one."""

    name: str
    capabilities: Capabilities
    extension = "txt"
    folder = "lines"
    # Declared options: required, option, example, description.
    options: tuple[tuple[bool, str, str, str], ...] = ()

    @abstractmethod
    def encode(self, records: DataFrame, context: Context) -> DataFrame: ...

    @abstractmethod
    def write(self, encoded: DataFrame, root: str, batch: str, options: dict) -> None: ...

    @abstractmethod
    def clear(self, spark: SparkSession, root: str) -> None:
        """Truncate what earlier batches wrote."""

    @abstractmethod
    def rescan(self, spark: SparkSession, root: str, batch: str | None = None) -> DataFrame:
        """``set``, ``record_hash`` and ``file_name`` (below ``root``) of every record in the files, of one batch or all."""

    def _written(self, root: str, batch: str | None) -> str:
        """The folder to read; a batch is a folder of its own, so only its files are opened."""
        return f"{root}/{self.folder}" if batch is None else f"{root}/{self.folder}/batch={batch}"

    def _below(self, path: Column) -> Column:
        """A file's name below the root, from its address."""
        plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
        return F.regexp_extract(plain, rf"/({self.folder}/batch=.*)$", 1)

    def check_options(self, given: dict) -> None:
        known = {option for _, option, _, _ in self.options}
        unknown = set(given) - known
        absent = {o for required, o, _, _ in self.options if required} - set(given)
        if unknown or absent:
            raise ValueError(f"{self.name}: unknown options {unknown}, missing options {absent}")


def write_lines(lines: DataFrame, path: str) -> None:
    """``(set, line)`` to text files, one folder per set."""
    (
        lines.select("set", F.col("line").alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("set")
        .option("lineSep", "\n")
        .text(path)
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as written, with their set; only a line feed ends a line."""
    text = spark.read.schema("value string, set string").option("lineSep", "\n").text(path)
    return text.select("set", F.col("value").alias("line"))


class _LineWriter(SetWriter):
    def finish(self, records: DataFrame, line: Column, reason: Column) -> DataFrame:
        keep = [c for c in records.columns if c not in ("entries", "reason")]
        lined = records.select(*keep, line.alias("payload"), reason.alias("reason"))
        return lined.withColumn("record_hash", md5_hex("payload"))

    def write(self, encoded: DataFrame, root: str, batch: str, options: dict) -> None:
        write_lines(encoded.select("set", F.col("payload").alias("line")), f"{root}/lines/batch={batch}")

    def clear(self, spark: SparkSession, root: str) -> None:
        write_lines(spark.createDataFrame([], "set string, line string"), f"{root}/lines")

    def rescan(self, spark: SparkSession, root: str, batch: str | None = None) -> DataFrame:
        text = (
            spark.read.schema("value string, batch string, set string")
            .option("lineSep", "\n")
            .option("basePath", f"{root}/lines")
            .text(self._written(root, batch))
        )
        return text.select("set", md5_hex("value").alias("record_hash"), self._below(F.col("_metadata.file_path")).alias("file_name"))


def _first(reasons: Column) -> Column:
    return F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0))


class TextWriter(_LineWriter):
    """Space-separated cells in output order, strings in quotes."""

    name, capabilities = "csv", Capabilities(resume=True, integrity=True, blobs=False)

    def encode(self, records: DataFrame, context: Context) -> DataFrame:
        cell = lambda e: cell_text(e, context.root + "/", context.tree, context.escape)
        line = output_line(F.col("entries"), context.job.fields, cell)
        broken = F.when(F.contains(line, F.lit("\n")), "line_break_in_value")
        return self.finish(records, line, F.coalesce("reason", broken))


def image_list_defect(source: Column, ground: Column) -> Column:
    """Why a record does not fit an image list, or NULL."""
    labelled = F.coalesce(ground["type"] == schema.STRING, F.lit(False)) & ground[
        "string_value"
    ].isNotNull()
    numbered = F.coalesce(ground["type"] == schema.NUMERIC, F.lit(False))
    return F.when(~F.coalesce(is_blob(source), F.lit(False)), "field_0_is_no_blob").when(
        ~(labelled | numbered), "field_1_is_no_label"
    )


class ImageListWriter(_LineWriter):
    """``path label`` lines; string labels become ids in order of first appearance."""

    name, capabilities = "imagelist", Capabilities(resume=True, integrity=True, blobs=False)

    def encode(self, records: DataFrame, context: Context) -> DataFrame:
        by_id = {f.id: f for f in context.job.fields}
        if not {0, 1} <= set(by_id):
            raise ValueError("an image list needs the output fields 0 and 1")
        source, ground = (last_of(F.col("entries"), by_id[i]) for i in (0, 1))
        flat = records.select(
            *[c for c in records.columns if c != "reason"],
            F.coalesce("reason", image_list_defect(source, ground)).alias("reason"),
            ground["string_value"].alias("label"),
            F.when(ground["dtype"] == "float", float_text(ground["float_value"]))
            .when(ground["dtype"] == "int", int_text(ground["int_value"]))
            .alias("_number"),
            blob_path(source["filename"], context.root + "/", context.tree).alias("_path"),
        )
        flat = staged(flat, "labelled")  # read twice: for the label table and for the lines
        fitting = flat.filter(F.col("reason").isNull() & F.col("label").isNotNull())
        ids = context.ledger.register_labels(
            fitting.select("label", "seq", "member_pos"), ["seq", "member_pos"], context.batch
        )
        joined = lookup_join(flat, ids, ["label"])
        places = {0: F.col("_path"), 1: F.coalesce(F.col("category_id").cast("string"), F.col("_number"))}
        line = join_fields([places.get(f.id, F.lit("")) for f in context.job.fields])
        helper = ("label", "_number", "_path", "category_id")
        return self.finish(joined, line, F.col("reason")).drop(*helper)


class RecordLinesWriter(_LineWriter):
    """The whole record as one JSON object per line."""

    name, capabilities = "jsonl", Capabilities(resume=True, integrity=True, blobs=False)
    extension = "jsonl"

    def encode(self, records: DataFrame, context: Context) -> DataFrame:
        kept = ("id", "type", "dtype", "filename", "url", "channels", "width", "height",
                "string_value", "int_value", "float_value", "optional")
        entries = F.transform(
            "entries",
            lambda e: F.struct(
                *[e[k].alias(k) for k in kept],
                F.when(is_blob(e), blob_path(e["filename"], context.root + "/", context.tree)).alias("file_uri"),
            ),
        )
        line = F.to_json(F.struct("set", F.col("api_hash").alias("hash"), entries.alias("entries")))
        return self.finish(records, line, F.col("reason"))


@F.arrow_udf(T.BinaryType())
def _examples(blobs: pa.Array, ints: pa.Array, floats: pa.Array) -> pa.Array:
    """Feature maps by kind to Example bytes."""
    rows = zip(blobs.to_pylist(), ints.to_pylist(), floats.to_pylist())
    return pa.array(
        [
            encode_example(
                {k: ("bytes", [v]) for k, v in b}
                | {k: ("int64", [v]) for k, v in i}
                | {k: ("float", [v]) for k, v in f}
            )
            for b, i, f in rows
        ],
        pa.binary(),
    )


class TFRecordWriter(SetWriter):
    """Example records by output field name."""

    name, capabilities = "tfrecords", Capabilities(resume=True, integrity=True, blobs=True)
    extension = "tfrecord"
    folder = "records"
    options = (
        (False, "entriesPerShard", "1000", "records per shard, 0 for one shard"),
        (False, "maxShardBytes", "100000000", "a shard is closed once it has this size, 0 for never"),
    )

    def encode(self, records: DataFrame, context: Context) -> DataFrame:
        keep = [c for c in records.columns if c != "entries"]
        outputs = F.array(
            *[F.struct(F.lit(f.id).alias("id"), F.lit(f.name).alias("name")) for f in context.job.fields]
        )
        # The last entry of each field, found once for the three kinds of features.
        lasts = records.select(
            *keep,
            F.transform(
                outputs, lambda o: F.struct(o["name"].alias("k"), last_with_id(F.col("entries"), o["id"]).alias("e"))
            ).alias("_lasts"),
        )

        def features(value, dtype: str) -> Column:
            pairs = F.transform("_lasts", lambda p: F.struct(p["k"].alias("k"), value(p["e"]).cast(dtype).alias("v")))
            return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))

        # An external blob is kept by its path, an inline one by its bytes.
        place = lambda e: blob_path(e["filename"], context.root + "/", context.tree).cast("binary")
        blobs = features(
            lambda e: F.when(e["type"] == schema.STRING, e["string_value"].cast("binary")).when(
                is_blob(e), F.coalesce(e["content"], place(e))
            ),
            "binary",
        )
        ints = features(lambda e: F.when(e["dtype"] == "int", e["int_value"]), "bigint")
        floats = features(
            lambda e: F.when((e["type"] == schema.NUMERIC) & (e["dtype"] == "float"), e["float_value"]), "float"
        )
        return (
            lasts.select(*keep, _examples(blobs, ints, floats).alias("payload"))
            .withColumn("record_hash", md5_hex("payload"))
        )

    def write(self, encoded: DataFrame, root: str, batch: str, options: dict) -> None:
        tfrecord.register(encoded.sparkSession)
        (
            encoded.select("set", F.col("payload").alias(tfrecord.RAW_RECORD))
            .write.format("tfrecord")
            .options(**options)
            .mode("overwrite")
            .save(f"{root}/records/batch={batch}")
        )

    def clear(self, spark: SparkSession, root: str) -> None:
        tfrecord.register(spark)
        nothing = spark.createDataFrame([], f"set string, {tfrecord.RAW_RECORD} binary")
        nothing.write.format("tfrecord").mode("overwrite").save(f"{root}/records")

    def rescan(self, spark: SparkSession, root: str, batch: str | None = None) -> DataFrame:
        tfrecord.register(spark)
        raw = spark.read.format("tfrecord").option("checksums", "ignore").load(self._written(root, batch))
        # Paths come from the file system, not from an address.
        name = F.regexp_extract("_file", rf"/({self.folder}/batch=.*)$", 1)
        return raw.select(F.col("_set").alias("set"), md5_hex("_record").alias("record_hash"), name.alias("file_name"))


class TensorWriter(SetWriter):
    """Parquet shards: per output field its shape, and the bytes of a blob or string or the number itself.

    The record hash is the MD5 of each field's value, one after the other; of a number, of its text.
    """

    name, capabilities = "tensor", Capabilities(resume=True, integrity=True, blobs=True)
    extension = "shard"
    folder = "tensors"
    options = ((False, "rowsPerShard", "100000", "rows per shard, 0 for one shard per task"),)

    def encode(self, records: DataFrame, context: Context) -> DataFrame:
        def cell(e: Column) -> Column:
            shape = [e[k].alias(k) for k in ("dtype", "channels", "width", "height")]
            data = F.when(is_blob(e), e["content"]).when(e["type"] == schema.STRING, e["string_value"].cast("binary"))
            number = e["type"] == schema.NUMERIC
            return F.struct(
                *shape,
                data.alias("data"),
                F.when(number & (e["dtype"] == "int"), e["int_value"]).alias("whole"),
                F.when(number & (e["dtype"] == "float"), e["float_value"]).alias("fraction"),
            )

        # The array around each entry binds it to a variable, so that it is looked up once.
        fields = context.job.fields
        per_field = F.struct(
            *[
                F.get(F.transform(F.array(last_of(F.col("entries"), f)), cell), F.lit(0)).alias(f.name)
                for f in fields
            ]
        )
        keep = [c for c in records.columns if c != "entries"]
        return (
            records.select(*keep, per_field.alias("payload"))
            .withColumn("record_hash", self._hash("payload", [f.name for f in fields]))
        )

    @staticmethod
    def _hash(payload: str, names: list[str]) -> Column:
        def one(cell: Column) -> Column:
            text = F.coalesce(cell["whole"].cast("string"), float_text(cell["fraction"]))
            return F.coalesce(F.md5(cell["data"]), F.md5(text.cast("binary")), F.lit(""))

        return F.concat(*[one(F.col(payload)[n]) for n in names])

    def write(self, encoded: DataFrame, root: str, batch: str, options: dict) -> None:
        (
            encoded.select("set", "payload.*")
            .write.mode("overwrite")
            .option("maxRecordsPerFile", int(options.get("rowsPerShard", 0)))
            .partitionBy("set")
            .parquet(f"{root}/tensors/batch={batch}")
        )

    def clear(self, spark: SparkSession, root: str) -> None:
        nothing = spark.createDataFrame([], "set string, batch string, data binary")
        (
            nothing.write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy("batch", "set")
            .parquet(f"{root}/tensors")
        )

    def rescan(self, spark: SparkSession, root: str, batch: str | None = None) -> DataFrame:
        shards = spark.read.option("basePath", f"{root}/tensors").parquet(self._written(root, batch))
        names = [c for c in shards.columns if c not in ("set", "batch")]
        packed = shards.select("set", F.struct(*names).alias("payload"), self._below(F.col("_metadata.file_path")).alias("file_name"))
        return packed.select("set", self._hash("payload", names).alias("record_hash"), "file_name")


WRITERS: dict[str, SetWriter] = {
    w.name: w
    for w in (TextWriter(), ImageListWriter(), RecordLinesWriter(), TFRecordWriter(), TensorWriter())
}


def shard_index(shards: DataFrame, extension: str = "shard") -> DataFrame:
    """The list of shards of each set, from a table with ``set`` and ``shard`` (from 0)."""
    return shards.select("set", "shard").distinct().select(
        "set",
        F.concat("set", (F.col("shard") + 1).cast("string"), F.lit(f".{extension}")).alias("file"),
    )


def writer_stats(lines: DataFrame) -> DataFrame:
    """Bytes per set, each line with its line feed."""
    size = F.octet_length("line").cast("bigint") + 1
    return lines.groupBy("set").agg(F.sum(size).alias("bytes"))


def blob_routing(external: Column, can_blobs: bool, path: Column, content: Column) -> Column:
    """Where a blob goes: its path if kept outside, else its bytes."""
    outside = external if can_blobs else F.lit(True)
    return F.struct(
        F.when(outside, path).alias("path"), F.when(~outside, content).alias("inline")
    )
