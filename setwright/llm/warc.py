"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by their key, so that shard ``i`` holds smaller keys than shard ``i + 1``. A shard is a
range of about ``shard_bytes`` of payload. Its bounds come from the rows alone, as running totals of payload bytes in key
order over a narrow table of keys, digests and sizes, and each row finds its shard by a binary search in them; so the
same rows give the same shards, files and bytes, however they are dealt over tasks. Each
range is written by one task, record by record, each record one gzip member; a file is closed
when it has reached ``roll_bytes`` compressed, and the next one begun. Headers and digests are
made anew from the payload; record ids and gzip headers hold no time and no chance, so a task that runs
again writes the same bytes. A file is written under a temporary name of the task attempt's own and renamed when whole. The
manifest (a Parquet table: file, records, bytes, SHA-1 of the file) is written last and is the commit; the
reader opens what the manifest names and nothing else.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the largest key holds the
payload (``response``); the others refer to it (``revisit``) and carry its digest and length. Who refers to whom is
found among keys and digests; these narrow rows meet the payloads in the shards, so payload bytes are shuffled once.

Defined results: a null payload is empty; records with the same largest key and equal payloads (repeated
rows) are all responses; a null key sorts first and is the largest only among nulls; an empty table
gives an empty manifest and no files. Line breaks and ``%`` in keys and addresses are escaped in headers.
Extra columns are ignored.

Files are written and read through pyarrow on whatever file system the folder's address names.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setwright.llm.textarrays import small_batches
from setwright.operators.numbering import running_totals
from setwright.session import scratch_path, staged
from setwright.sinks.shared_files import open_base

ROLL_BYTES = 64 << 20
#: Payload bytes of a shard, before compression, with a header's worth for each record.
SHARD_BYTES = 32 << 20
_HEADER_BYTES = 512
_COMPRESSION = 3
_CHUNK = 1 << 20
_PAD = b"\r\n\r\n"

MANIFEST = "file string, shard int, records bigint, bytes bigint, sha1 string"
RECORDS = "key {key}, payload_bytes bigint, payload_digest string, record_type string, refers_to {key}, url string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str, digest: str) -> str:
    """The same for the same key and payload, so that repeated attempts agree."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"


def _escaped(value: str) -> str:
    """A line break would end the header."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unescaped(value: str | None) -> str | None:
    return None if value is None else value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit without the payload."""
    digest = base32_sha1(payload)
    name = "" if key is None else key
    revisit = refers_to is not None
    body = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(name, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(body)}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Type: {'application/octet-stream' if revisit else 'text/html; charset=utf-8'}",
        f"Content-Length: {len(body)}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {_escaped(url)}")
    if key is not None:
        lines.append(f"X-Record-Key: {_escaped(key)}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        lines.append(f"X-Refers-To-Key: {_escaped(refers_to)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + _PAD + body + _PAD


def gzip_member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(_COMPRESSION, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Shard:
    """The files of one range, in order."""

    def __init__(self, base: str, shard: int, roll_bytes: int):
        self.fs, self.base = open_base(base)
        self.shard, self.roll, self.number = shard, roll_bytes, 0
        self.attempt = uuid.uuid4().hex
        self.out = None
        self.closed: list[tuple] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temporary = posixpath.join(self.base, "_temporary", f"{self.attempt}-{self.shard:06d}-{self.number:05d}")
            self.fs.create_dir(posixpath.dirname(self.temporary), recursive=True)
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.records = self.bytes = 0
            self.sha = hashlib.sha1()
        member = gzip_member(data)
        self.out.write(member)
        self.sha.update(member)
        self.records += 1
        self.bytes += len(member)
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.fs.move(self.temporary, posixpath.join(self.base, name))
        self.closed.append((name, self.shard, self.records, self.bytes, self.sha.hexdigest()))
        self.number += 1


def references(narrow: DataFrame, revisit_bytes: int) -> DataFrame:
    """``key, tie, refers_to`` of the revisits among rows ``key, tie, size`` (``tie`` is the payload's digest)."""
    long_enough = narrow.filter(F.col("size") >= revisit_bytes)
    # Only payloads that occur under more than one key have revisits.
    several = F.col("newest").isNotNull() & ((F.col("newest") != F.col("oldest")) | (F.col("nulls") > 0))
    shared = staged(
        long_enough.groupBy(F.col("tie").alias("of")).agg(F.max("key").alias("newest"), F.min("key").alias("oldest"), F.count_if(F.col("key").isNull()).alias("nulls"))
        .filter(several).select("of", "newest"),
        "shared_payloads",
    )
    met = long_enough.join(shared, long_enough["tie"] == shared["of"]).filter(~F.col("key").eqNullSafe(F.col("newest")))
    return staged(met.select("key", "tie", F.col("newest").alias("refers_to")).distinct(), "references")


def shard_bounds(narrow: DataFrame, shard_bytes: int) -> DataFrame:
    """The first ``(key, tie)`` of every shard but the first, as one row ``bounds`` of one entry per shard."""
    sized = narrow.select("key", "tie", (F.col("size") + _HEADER_BYTES).cast("bigint").alias("weight"), F.lit(0).alias("all"))
    before = running_totals(sized, "all", ["key", "tie"], "weight", "before")
    first = before.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard")).agg(F.min(F.struct("key", "tie")).alias("bound"))
    return staged(first.filter("shard > 0").agg(F.sort_array(F.collect_list("bound")).alias("bounds")), "bounds")


def _shard(steps: int) -> Column:
    """How many bounds a row's ``(key, tie)`` has reached: a binary search by halving steps."""
    row, held = F.struct("key", "tie"), F.col("_bounds")

    def step(at: Column, width: Column) -> Column:
        reached = (at + width <= F.size(held)) & (F.get(held, at + width - 1) <= row)
        return F.when(reached, at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0), step)


def write_warc(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    payload: str = "html",
    url: str | None = "url",
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row below ``path`` and return the manifest as committed."""
    spark = pages.sparkSession
    rows = pages.select(
        pages[key].alias("key"),
        (pages[url].cast("string") if url else F.lit(None).cast("string")).alias("url"),
        F.encode(F.coalesce(pages[payload].cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("tie", F.unhex(F.sha1("payload")))
    narrow = staged(rows.select("key", "tie", F.octet_length("payload").cast("bigint").alias("size")), "keys")
    refers = references(narrow, revisit_bytes)
    bounds = shard_bounds(narrow, shard_bytes)
    shards = bounds.select(F.size("bounds")).first()[0] + 1

    def dealt(side: DataFrame) -> DataFrame:
        placed = side.withColumn("_bounds", bounds.scalar())
        return placed.withColumn("shard", _shard(shards.bit_length())).drop("_bounds")

    kind = narrow.schema["key"].dataType.simpleString()
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    marks = refers.select("key", "tie", none("url", "string"), none("payload", "binary"), "refers_to", F.lit(0).alias("row"))
    written = rows.select("key", "tie", "url", "payload", none("refers_to", kind), F.lit(1).alias("row"))
    # What a record refers to comes just before it.
    ordered = dealt(marks).unionByName(dealt(written)).repartition(shards, "shard").sortWithinPartitions("shard", "key", "tie", "row", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, mark, closed = None, (None, None, None), []
        for batch in batches:
            for i in range(batch.num_rows):
                n, k, t, u, p, r, row = (batch.column(c)[i].as_py() for c in ("shard", "key", "tie", "url", "payload", "refers_to", "row"))
                if row == 0:
                    mark = (k, t, r)
                    continue
                if out is None or out.shard != n:
                    if out is not None:
                        out.close()
                        closed += out.closed
                    out = _Shard(path, n, roll_bytes)
                refers_to = str(mark[2]) if mark[1] is not None and mark[:2] == (k, t) else None
                out.add(record(None if k is None else str(k), u, p, refers_to, date))
        if out is not None:
            out.close()
            closed += out.closed
        columns = list(zip(*closed)) or [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "shard", "records", "bytes", "sha1"]
        )

    manifest = f"{path}/_manifest"
    small_batches(ordered).mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member; holds one member at a time."""
    left = stream.read(_CHUNK)
    while left:
        unpacker = zlib.decompressobj(31)
        parts = []
        while not unpacker.eof:
            if not left:
                raise ValueError("a gzip member is cut off")
            parts.append(unpacker.decompress(left))
            left = unpacker.unused_data if unpacker.eof else stream.read(_CHUNK)
        left = left or stream.read(_CHUNK)
        yield b"".join(parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; refuses a record that contradicts its own headers."""
    head, _, rest = data.partition(_PAD)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != _PAD or base32_sha1(block) != headers["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError("a record's block does not match its headers")
    return headers, block


def read_warc(spark, path: str, key_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """Read the archives that the manifest below ``path`` names; one row per record.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload: of a response as found in the
    record, of a revisit as its headers give them. ``payloads`` adds a response's bytes. Files are dealt
    out one to a task slot; a task holds one record at a time.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    kind = f"key string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_base(path)
        names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(posixpath.join(base, name), compression=None) as stream:
                    for data in members(stream):
                        rows.append(_row(*parsed(data), payloads))
                        held += len(rows[-1][-1] or b"") + 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    found = manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(run, kind)
    out = found.select(
        F.col("key").cast(key_type).alias("key"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(key_type).alias("refers_to"), "url", "payload",
    )
    return out if payloads else out.drop("payload")


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = headers["WARC-Type"]
    length, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        length, found = len(block), base32_sha1(block)
        if found != digest:
            raise ValueError("a record's payload does not match its digest")
    return (
        _unescaped(headers.get("X-Record-Key")), length, digest, kind, _unescaped(headers.get("X-Refers-To-Key")),
        _unescaped(headers.get("WARC-Target-URI")), block if payloads and kind == "response" else None,
    )


def warc_roundtrip(pages: DataFrame, path: str | None = None, key: str = "page_id", **options) -> DataFrame:
    """Write the archives (below the shared folder if no path is given) and read them back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    key_type = pages.select(pages[key]).schema[0].dataType.simpleString()
    write_warc(pages, path, key=key, **options)
    back = read_warc(spark, path, key_type)
    return back.select(F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
