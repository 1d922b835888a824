"""``format("tfrecord")``: Example records, one folder per set, greedy shards.

Write options: ``path``; ``setColumn`` (default ``set``); ``entriesPerShard``
and ``maxShardBytes`` (0, the default, means no limit). Read options: ``path``;
``checksums`` (``fail``, the default, or ``ignore`` to hand out damaged records
so that a verification can count them). A read schema names the features
wanted; ``_set``, ``_file`` and ``_record`` give the origin and the raw bytes.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from setwright.sinks.crc32c import masked_crc32c
from setwright.sinks.example_proto import decode_example, encode_example
from setwright.sinks.shared_files import files_below, open_base

SUFFIX = ".tfrecord"
# A column of this name holds whole records, written as they are.
RAW_RECORD = "_record"
_HEAD, _TAIL = 12, 4  # length and its checksum; checksum of the data
_BATCH_ROWS, _BATCH_BYTES = 4096, 16 * 1024 * 1024
# Bytes that one task reads, unless a file has more, and what opening a file counts for.
_TASK_BYTES, _OPEN_BYTES = 32 * 1024 * 1024, 256 * 1024

# Declared options of the writer: required, option, example, description.
OPTIONS = (
    (True, "path", "/data/out", "folder the sets are written below"),
    (False, "setColumn", "set", "column that names the set of a record"),
    (False, "entriesPerShard", "1000", "records per shard, 0 for one shard"),
    (False, "maxShardBytes", "100000000", "a shard is closed once it has this size, 0 for never"),
)


def frame(records: list[bytes]) -> list[bytes]:
    """Each record with its length and checksums around it."""
    lengths = [struct.pack("<Q", len(r)) for r in records]
    heads, tails = masked_crc32c(lengths), masked_crc32c(records)
    return [
        b"".join((n, struct.pack("<I", h), r, struct.pack("<I", t)))
        for n, h, r, t in zip(lengths, heads.tolist(), records, tails.tolist())
    ]


def _kind(dt: T.DataType) -> str:
    element = dt.elementType if isinstance(dt, T.ArrayType) else dt
    if isinstance(element, (T.BinaryType, T.StringType)):
        return "bytes"
    if isinstance(element, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(element, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    raise ValueError(f"a TFRecord feature cannot hold {dt.simpleString()}")


def _feature_values(value, kind: str) -> list:
    values = value if isinstance(value, (list, np.ndarray)) else [value]
    return [v.encode() if isinstance(v, str) else v for v in values] if kind == "bytes" else list(values)


def encode_batch(batch: pa.RecordBatch, kinds: dict[str, str]) -> list[bytes]:
    """Rows of a batch as Example records; NULL features are left out."""
    if RAW_RECORD in kinds:
        return batch.column(RAW_RECORD).to_pylist()
    columns = [(name, kinds[name], batch.column(name).to_pylist()) for name in kinds]
    return [
        encode_example(
            {n: (k, _feature_values(c[i], k)) for n, k, c in columns if c[i] is not None}
        )
        for i in range(batch.num_rows)
    ]


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # (temporary, final)


class _Shard:
    """The open shard of one set in one task; full shards are closed greedily."""

    def __init__(self, writer: "_Writer", set_name: str, task: str, done: list):
        self.writer, self.set_name, self.task, self.done = writer, set_name, task, done
        self.number, self.out = 0, None

    def append(self, records: list[bytes]) -> None:
        for data in frame(records):
            if self.out is None:
                name = f"set={self.set_name}/{self.set_name}-{self.task}-{self.number:05d}{SUFFIX}"
                temporary = f"{self.writer.base}/_temporary/{self.writer.job}/{name}"
                self.writer.fs.create_dir(temporary.rsplit("/", 1)[0], recursive=True)
                self.out = self.writer.fs.open_output_stream(temporary)
                self.done.append((temporary, f"{self.writer.base}/{name}"))
                self.entries = self.size = 0
            self.out.write(data)
            self.entries += 1
            self.size += len(data)
            if 0 < self.writer.entries <= self.entries or 0 < self.writer.bytes <= self.size:
                self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.number += 1


class _Writer(DataSourceArrowWriter):
    """Tasks write to temporary names; the driver renames on commit."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.set_column = options.get("setcolumn", "set")
        self.entries = int(options.get("entriespershard", 0))
        self.bytes = int(options.get("maxshardbytes", 0))
        if self.set_column not in schema.names:
            raise ValueError(f"no set column {self.set_column}")
        self.kinds = {f.name: _kind(f.dataType) for f in schema if f.name != self.set_column}
        self.job = uuid.uuid4().hex

    def _open(self) -> None:
        self.fs, self.base = open_base(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        self._open()
        context = TaskContext.get()
        task = f"{self.job[:8]}-{context.partitionId():05d}-{context.taskAttemptId()}"
        message, shards = _Written(), {}
        for batch in iterator:
            records = encode_batch(batch, self.kinds)
            by_set: dict[str, list[bytes]] = {}
            for name, record in zip(batch.column(self.set_column).to_pylist(), records):
                by_set.setdefault(name, []).append(record)
            for name, group in by_set.items():
                if name not in shards:
                    shards[name] = _Shard(self, name, task, message.files)
                shards[name].append(group)
        for shard in shards.values():
            shard.close()
        return message

    def commit(self, messages: list) -> None:
        self._open()
        old = files_below(self.fs, self.base, SUFFIX) if self.overwrite else []
        made = set()
        for message in messages:
            for temporary, final in message.files if message else []:
                folder = final.rsplit("/", 1)[0]
                if folder not in made:
                    self.fs.create_dir(folder, recursive=True)
                    made.add(folder)
                self.fs.move(temporary, final)
        for info in old:
            self.fs.delete_file(info.path)
        self._drop_temporary()

    def abort(self, messages: list) -> None:
        self._open()
        self._drop_temporary()

    def _drop_temporary(self) -> None:
        mine = f"{self.base}/_temporary/{self.job}"
        if self.fs.get_file_info(mine).type == fs.FileType.Directory:
            self.fs.delete_dir(mine)


@dataclass
class _Files(InputPartition):
    """Shard files that one task reads one after the other."""

    paths: list[str]

    def __post_init__(self):
        super().__init__(self.paths)


def bundled(files: list[fs.FileInfo]) -> list[list[str]]:
    """Neighbouring files in groups for one task each: a large file is alone, small ones share a task."""
    groups, held = [], _TASK_BYTES
    for info in files:
        cost = (info.size or 0) + _OPEN_BYTES
        if held + cost > _TASK_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(info.path)
        held += cost
    return groups


def read_records(stream, check: bool) -> Iterator[list[bytes]]:
    """Batches of raw records of one file; checksums are checked per batch."""
    records, heads, sizes, sums, held = [], [], [], [], 0

    def checked() -> list[bytes]:
        if check and (
            (masked_crc32c(sizes) != np.array(heads, np.uint32)).any()
            or (masked_crc32c(records) != np.array(sums, np.uint32)).any()
        ):
            raise ValueError("a record does not match its checksum")
        return records

    while True:
        head = stream.read(_HEAD)
        if not head:
            break
        if len(head) < _HEAD:
            raise ValueError("the file ends inside a record")
        size, head_sum = struct.unpack("<QI", head)
        # A large length is checked before it is trusted; the others with their batch.
        if check and size > _BATCH_BYTES and masked_crc32c([head[:8]])[0] != head_sum:
            raise ValueError("a record length does not match its checksum")
        body = stream.read(size + _TAIL)
        if len(body) < size + _TAIL:
            raise ValueError("the file ends inside a record")
        records.append(body[:size])
        sizes.append(head[:8])
        heads.append(head_sum)
        sums.append(struct.unpack("<I", body[size:])[0])
        held += size
        if len(records) >= _BATCH_ROWS or held >= _BATCH_BYTES:
            yield checked()
            records, heads, sizes, sums, held = [], [], [], [], 0
    if records:
        yield checked()


class _Reader(DataSourceReader):
    """Input partitions of whole shard files; small ones are read by one task, so that tasks grow with the bytes."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.check = options.get("checksums", "fail") != "ignore"

    def partitions(self) -> list[_Files]:
        filesystem, base = open_base(self.path)
        return [_Files(paths) for paths in bundled(files_below(filesystem, base, SUFFIX))] or [_Files([])]

    def _column(self, f: T.StructField, records: list[bytes], features: list[dict], path: str) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(f.dataType)
        if f.name == RAW_RECORD:
            return pa.array(records, arrow)
        if f.name == "_file":
            return pa.array([path] * len(records), arrow)
        if f.name == "_set":
            found = re.search(r"/set=([^/]+)/", path)
            return pa.array([found.group(1) if found else None] * len(records), arrow)
        values = [e.get(f.name) for e in features]
        text = isinstance(f.dataType, T.StringType)
        if isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, T.StringType):
                values = [v and [x.decode() for x in v] for v in values]
        else:
            values = [(v[0].decode() if text else v[0]) if v else None for v in values]
        return pa.array(values, arrow)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        filesystem, _ = open_base(self.path)
        parse = any(not f.name.startswith("_") for f in self.schema)
        for path in partition.paths:
            with filesystem.open_input_stream(path, buffer_size=1 << 20) as stream:
                for records in read_records(stream, self.check):
                    features = [decode_example(r) for r in records] if parse else []
                    yield pa.RecordBatch.from_arrays(
                        [self._column(f, records, features, path) for f in self.schema],
                        names=self.schema.names,
                    )


class TFRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return "_set string, _file string, _record binary"

    def _checked(self) -> dict:
        options = {k.lower(): v for k, v in self.options.items()}
        if "path" not in options:
            raise ValueError("option path is required")
        return options

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self._checked(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self._checked(), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TFRecordSource)
