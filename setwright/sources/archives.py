"""Archives (tar and zip, also compressed) as a table function."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setwright import schema
from setwright.operators.joins import needed_only
from setwright.sources.assets import one_per_url
from setwright.sources.feed import parse_entry
from setwright.sources.job import Field

_ROW = T.StructType(
    [
        T.StructField("member", T.StringType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("manifest_pos", T.IntegerType()),
        T.StructField("manifest_entry", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


# Leading bytes of a zip; anything else is read as a tar, whatever its members hold.
_ZIP = (b"PK\x03\x04", b"PK\x05\x06")


def _members(content: bytes, wanted: Callable[[int, str], bool]) -> Iterator[tuple[int, str, bytes | None]]:
    """The plain files of one archive in order, with bytes where they are wanted; one member is held at a time."""
    if content[:4] in _ZIP:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            files = (i for i in z.infolist() if not i.is_dir())
            for at, i in enumerate(files):
                yield at, i.filename, z.read(i) if wanted(at, i.filename) else None
        return
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
        files = (m for m in t if m.isfile())
        for at, m in enumerate(files):
            yield at, m.name, t.extractfile(m).read() if wanted(at, m.name) else None


def _manifest(body: bytes) -> list[dict]:
    entries = json.loads(body.decode("utf-8"))
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError("the manifest is not an array of objects")
    return entries


class _UnpackArchive:
    """One row per member, paired with its manifest entry.

    The whole archive is one input value, so members meet their entries here by
    name and nothing has to be shuffled for it; equal names in two archives
    cannot meet.
    """

    def eval(self, content: bytes) -> Iterator[tuple]:
        if not content:
            yield None, None, None, None, "missing_payload"
            return
        content, last, listing = bytes(content), {}, None
        try:
            # The manifest may stand anywhere, so names come first; a repeated name keeps the last.
            for at, name, body in _members(content, lambda _, n: n == schema.MANIFEST_MEMBER):
                last[name] = at
                listing = body if name == schema.MANIFEST_MEMBER else listing
        except Exception:  # a damaged archive is data, not a failure of the job
            yield None, None, None, None, "broken_archive"
            return
        entries, problem = [], None
        if listing is None:
            problem = "no_manifest"
        else:
            try:
                entries = _manifest(listing)
            except ValueError:
                problem = "bad_manifest"
        if problem:
            yield None, None, None, None, problem
            return
        last.pop(schema.MANIFEST_MEMBER)
        places: dict[str, list[int]] = {}
        for pos, entry in enumerate(entries):
            name = entry.get("filename")
            if isinstance(name, str) and name in last:
                places.setdefault(name, []).append(pos)
            else:
                yield None, None, pos, json.dumps(entry), "missing_member"
        damaged = False
        members = _members(content, lambda at, n: last.get(n) == at)
        while True:
            try:
                _, name, body = next(members)
            except StopIteration:
                break
            except Exception:
                damaged = True
                break
            if body is None:
                continue
            del last[name]
            if name not in places:
                yield name, body, None, None, None
            for pos in places.pop(name, ()):
                yield name, body, pos, json.dumps(entries[pos]), None if body else "missing_member"
        if damaged:  # what could not be read is refused, entry by entry
            for name in places:
                for pos in places[name]:
                    yield None, None, pos, json.dumps(entries[pos]), "broken_archive"


unpack_archive = F.udtf(_UnpackArchive, returnType=_ROW)


def unpack(archives: DataFrame, content: str = "content") -> DataFrame:
    """Lateral-join each archive row with its members; ``content`` is dropped."""
    return archives.lateralJoin(unpack_archive(F.col(content).outer())).drop(content)


def archive_members(archives: DataFrame) -> DataFrame:
    """Every member but the manifest, or one row with ``error`` for a bad archive."""
    return unpack(archives).drop("manifest_pos", "manifest_entry")


def holds_archive(entries: str = "entries") -> Column:
    return F.exists(entries, lambda e: e["type"] == schema.ARCHIVE)


def expand_archives(
    records: DataFrame,
    assets: DataFrame,
    mapping: tuple[Field, ...],
    keep_content: bool = True,
) -> DataFrame:
    """Replace each record that holds archives by one record per manifest entry.

    New records keep the parent's set, hash, seq and other entries, and add
    ``member_pos``, their place in the archive. Other records pass through.
    A bad archive or a listed member that is missing gives a row with a reason.
    """
    is_archive = lambda e: e["type"] == schema.ARCHIVE
    keep = [c for c in records.columns if c not in ("entries", "reason")]
    holds = holds_archive() & F.col("reason").isNull()
    plain = records.filter(~holds).select(
        *keep, F.lit(0).cast("bigint").alias("member_pos"), "entries", "reason"
    )
    opened = records.filter(holds).select(
        *keep,
        F.filter("entries", lambda e: ~is_archive(e)).alias("_rest"),
        F.posexplode(F.filter("entries", is_archive)).alias("_no", "_archive"),
    ).withColumn("url", F.col("_archive.url"))
    asked = one_per_url(needed_only(assets.select("url", "content"), opened, ["url"]))
    fetched = opened.drop("_archive").join(asked, "url", "left")
    members = unpack(fetched).filter(
        F.col("error").isNotNull() | F.col("manifest_pos").isNotNull()
    )
    entry = parse_entry(F.try_parse_json("manifest_entry"), mapping)
    filled = F.struct(
        *[
            (
                F.when(F.lit(keep_content), F.col("body"))
                if f == "content"
                else F.md5("body")
                if f == "digest"
                else F.octet_length("body").cast("bigint")
                if f == "n_bytes"
                else F.col("_entry")[f]
            ).alias(f)
            for f in T.StructType.fromDDL(schema.ENTRY[len("struct<") : -1]).names
        ]
    )
    expanded = members.withColumn("_entry", F.when(F.col("error").isNull(), entry)).select(
        *keep,
        (F.shiftleft(F.col("_no").cast("bigint"), 32) + F.coalesce("manifest_pos", F.lit(0))).alias(
            "member_pos"
        ),
        F.when(F.col("error").isNull(), F.concat("_rest", F.array(filled)))
        .otherwise(F.col("_rest"))
        .alias("entries"),
        F.coalesce("error", F.col("_entry.reason")).alias("reason"),
    )
    return plain.unionByName(expanded)
