"""Assets, payload joins, archives and images."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.registry import FIELDS, JOB, SET_SQL, entry_struct, query, set_of, table
from setwright.functions.text import blob_path, name_matches_content
from setwright.plans.export import export, verify_local
from setwright.session import scratch_path, staged
from setwright.sinks import blobfiles
from setwright.sinks.writers import blob_routing
from setwright.sources import archives, assets


def page_assets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.col("html").cast("binary").alias("content")
    )


@query("asset_scan", "SELECT md5(url) AS url_key, CAST(max(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY url")
def asset_scan(spark, sf_dir):
    """One row per URL, though every asset was fetched twice."""
    a = page_assets(spark, sf_dir)
    twice = a.unionByName(a)
    return assets.distinct_assets(twice).select("url_key", F.octet_length("content").cast("bigint").alias("bytes"))


@query(
    "payload_join",
    """SELECT page_id, CASE WHEN page_id % 10 <> 1 THEN CAST(strlen(html) AS BIGINT) END AS bytes,
    CASE WHEN page_id % 10 <> 1 THEN md5(html) END AS digest FROM pages""",
)
def payload_join(spark, sf_dir):
    """Hash at the asset, shuffle the hash."""
    a = page_assets(spark, sf_dir)
    facts = assets.with_digest(a.filter(F.col("page_id") % 10 != 1)).select("url", "digest", "n_bytes")
    joined = assets.join_payload(a.select("page_id", "url"), facts)
    return joined.select("page_id", F.col("n_bytes").alias("bytes"), "digest")


@query("missing_payload", "SELECT page_id FROM pages WHERE page_id % 10 IN (1, 2)")
def missing_payload(spark, sf_dir):
    """No asset (residue 1) or an empty one (residue 2)."""
    a = page_assets(spark, sf_dir)
    there = a.filter(F.col("page_id") % 10 != 1).withColumn(
        "content", F.when(F.col("page_id") % 10 == 2, F.lit(b"")).otherwise(F.col("content"))
    )
    return assets.missing_payload(a.select("page_id", "url"), there).select("page_id")


@query(
    "fetch_stats",
    """SELECT count(*) FILTER (page_id % 10 NOT IN (0, 1)) AS success, count(*) FILTER (page_id % 10 = 0) AS empty,
    count(*) FILTER (page_id % 10 = 1) AS error, count(*) AS completed,
    CAST(sum(strlen(html)) FILTER (page_id % 10 NOT IN (0, 1)) AS BIGINT) AS bytes FROM pages""",
)
def fetch_stats(spark, sf_dir):
    r = page_assets(spark, sf_dir).select(
        F.when(F.col("page_id") % 10 == 1, 500).otherwise(200).alias("status"),
        F.when(F.col("page_id") % 10 != 0, F.col("content")).alias("content"),
    )
    return assets.fetch_stats(r)


@query(
    "content_hash_check",
    "SELECT page_id, page_id % 10 <> 0 AS ok FROM pages",
)
def content_hash_check(spark, sf_dir):
    name = F.when(F.col("page_id") % 10 == 0, F.md5("url")).otherwise(F.md5("content"))
    return page_assets(spark, sf_dir).select(
        "page_id", name_matches_content(F.concat(name, F.lit(".html.gz")), "content").alias("ok")
    )


@query(
    "blob_routing",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'data/' || substr(f, 1, 1) || '/' || substr(f, 2, 1) || '/' || substr(f, 3, 1) || '/' || f END AS path,
    CASE WHEN doc_id % 2 = 1 THEN md5(text) END AS inline_digest FROM (SELECT *, md5(text) || '.txt' AS f FROM documents)""",
)
def blob_routing_(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = blob_path(F.concat(F.md5("text"), F.lit(".txt")))
    routed = d.select("doc_id", blob_routing(F.col("doc_id") % 2 == 0, True, path, F.col("text").cast("binary")).alias("r"))
    return routed.select("doc_id", "r.path", F.md5("r.inline").alias("inline_digest"))


# --- archives: one tar per 25 pages, with a manifest -----------------------------------

GROUP = 25


def _pack(pages: pd.DataFrame) -> pd.DataFrame:
    """The tar of one group of at most 25 pages; every tenth is junk or lacks its manifest."""
    grp = int(pages["grp"].iloc[0])
    pages = pages.sort_values("page_id")
    members = list(zip(pages["fname"], (h.encode() for h in pages["html"])))
    manifest = [{"type": "raw", "dtype": "uint8", "id": 0, "filename": n} for n, _ in members]
    if grp % 10 != 7:
        members.append(("file_id.diz", json.dumps(manifest).encode()))
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz" if grp % 2 else "w") as t:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    content = b"this is no archive" if grp % 10 == 3 else out.getvalue()
    return pd.DataFrame({"grp": [grp], "content": [content]})


def _pack_with_zip(pages: pd.DataFrame) -> pd.DataFrame:
    """The same, with a zip as the last member of some archives, which are tars all the same."""
    packed = _pack(pages)
    if int(packed["grp"].iloc[0]) % 10 in (0, 2):  # these are not compressed, so they can be added to
        inner, out = io.BytesIO(), io.BytesIO(packed["content"].iloc[0])
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr("a", "b")
        with tarfile.open(fileobj=out, mode="a:") as t:
            info = tarfile.TarInfo("last.zip")
            info.size = len(inner.getvalue())
            t.addfile(info, io.BytesIO(inner.getvalue()))
        packed["content"] = [out.getvalue()]
    return packed


def packed_archives(spark, sf_dir, pack=_pack):
    pages = table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / GROUP).alias("grp"),
        "page_id",
        F.concat(F.md5("html"), F.lit(".html")).alias("fname"),
        "html",
    )
    return pages.groupBy("grp").applyInPandas(pack, "grp bigint, content binary")


ARCHIVE_SQL = "SELECT page_id, page_id // 25 AS grp, md5(html) || '.html' AS fname, html FROM pages"


@query(
    "archive_members",
    f"""SELECT grp, fname AS member, CAST(strlen(html) AS BIGINT) AS bytes FROM ({ARCHIVE_SQL}) WHERE grp % 10 NOT IN (3, 7)""",
)
def archive_members(spark, sf_dir):
    members = archives.archive_members(packed_archives(spark, sf_dir))
    return members.filter(F.col("error").isNull()).select(
        "grp", "member", F.octet_length("body").cast("bigint").alias("bytes")
    )


@query(
    "archive_manifest",
    f"""SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY page_id) - 1 AS pos, fname AS filename, CAST(0 AS BIGINT) AS out_id
    FROM ({ARCHIVE_SQL}) WHERE grp % 10 NOT IN (3, 7)""",
)
def archive_manifest(spark, sf_dir):
    from setwright.sources.feed import parse_entry

    listed = archives.unpack(packed_archives(spark, sf_dir)).filter(F.col("manifest_pos").isNotNull())
    e = listed.select("grp", "manifest_pos", parse_entry(F.try_parse_json("manifest_entry"), FIELDS).alias("e"))
    return e.select(
        "grp",
        F.col("manifest_pos").cast("bigint").alias("pos"),
        F.col("e.filename").alias("filename"),
        F.col("e.id").cast("bigint").alias("out_id"),
    )


def archive_feed(spark, sf_dir, pack=_pack):
    """One feed record per archive, with a label entry beside it; and the archives as assets."""
    packed = staged(
        packed_archives(spark, sf_dir, pack).select(
            "grp", F.concat(F.lit("http://archives/"), F.col("grp").cast("string")).alias("url"), "content"
        ),
        "archives",
    )
    entries = F.array(
        entry_struct(1, "string", string_value=F.concat(F.lit("g"), F.col("grp").cast("string"))),
        entry_struct(0, "archive", url=F.col("url")),
    )
    records = packed.select(
        "grp",
        F.col("grp").alias("seq"),
        set_of("grp").alias("set"),
        F.md5("url").alias("api_hash"),
        entries.alias("entries"),
        F.lit(None).cast("string").alias("reason"),
    )
    return records, packed.select("url", "content")


def archive_records(spark, sf_dir):
    return archives.expand_archives(*archive_feed(spark, sf_dir), FIELDS)


@query(
    "export_archives",
    f"""WITH A AS (SELECT * FROM ({ARCHIVE_SQL})), G AS (SELECT DISTINCT grp FROM A)
    SELECT CASE grp % 10 WHEN 3 THEN 'broken_archive' WHEN 5 THEN 'missing_payload' WHEN 7 THEN 'no_manifest' END AS outcome, count(*) AS n
    FROM G WHERE grp % 10 IN (3, 5, 7) GROUP BY 1
    UNION ALL SELECT 'written', count(*) FROM A WHERE grp % 10 NOT IN (3, 5, 7)
    UNION ALL SELECT 'verified', count(*) FROM A WHERE grp % 10 NOT IN (3, 5, 7)""",
)
def export_archives(spark, sf_dir):
    """Archives through the whole export: every asset listed twice, some lacking, some tars ending in a zip."""
    records, held = archive_feed(spark, sf_dir, _pack_with_zip)
    some = held.join(records.filter("grp % 10 <> 5").select(F.concat(F.lit("http://archives/"), F.col("grp").cast("string")).alias("url")), "url").select("url", "content")
    out = scratch_path(spark, "archives-out")
    done = export(records.drop("grp"), JOB, out, "jsonl", some.unionByName(some))
    counted = done.rejects.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    written = done.written.agg(F.lit("written").alias("outcome"), F.count(F.lit(1)).alias("n"))
    verified = verify_local(spark, out, "jsonl").select(F.lit("verified").alias("outcome"), F.col("found").alias("n"))
    return counted.unionByName(written).unionByName(verified)


@query(
    "archive_expand",
    f"""SELECT grp, {SET_SQL.format(k='grp')} AS "set", md5('http://archives/' || CAST(grp AS VARCHAR)) AS api_hash,
    row_number() OVER (PARTITION BY grp ORDER BY page_id) - 1 AS member_pos,
    'g' || CAST(grp AS VARCHAR) AS label, fname AS filename, md5(html) AS digest
    FROM ({ARCHIVE_SQL}) WHERE grp % 10 NOT IN (3, 7)""",
)
def archive_expand(spark, sf_dir):
    expanded = archive_records(spark, sf_dir).filter(F.col("reason").isNull())
    e = F.col("entries")
    return expanded.select(
        "grp",
        "set",
        "api_hash",
        "member_pos",
        e[0]["string_value"].alias("label"),
        e[1]["filename"].alias("filename"),
        F.md5(e[1]["content"]).alias("digest"),
    )


@query(
    "archive_rejects",
    f"""SELECT DISTINCT grp, CASE grp % 10 WHEN 3 THEN 'broken_archive' ELSE 'no_manifest' END AS reason
    FROM ({ARCHIVE_SQL}) WHERE grp % 10 IN (3, 7)""",
)
def archive_rejects(spark, sf_dir):
    return archive_records(spark, sf_dir).filter(F.col("reason").isNotNull()).select("grp", "reason")


# --- images: a 4 x 4 RGBA picture from each embedding -----------------------------------


def _png(pixels: bytes, width: int, height: int) -> bytes:
    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + pixels[r * width * 4 : (r + 1) * width * 4] for r in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@F.arrow_udf(T.BinaryType())
def _png_of(pixels: pa.Array) -> pa.Array:
    return pa.array([_png(bytes(p), 4, 4) for p in pixels.to_pylist()], pa.binary())


BYTE_SQL = "CAST(floor((greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) + 1.0) * 127.5) AS INTEGER)"


@query(
    "image_scan",
    f"""WITH P AS (SELECT vec_id, list_transform(embedding, lambda x: {BYTE_SQL}) AS p FROM embeddings)
    SELECT vec_id, vec_id % 50 <> 0 AS ok, CAST(CASE WHEN vec_id % 50 = 0 THEN -1 ELSE 4 END AS BIGINT) AS height,
    CAST(CASE WHEN vec_id % 50 = 0 THEN -1 ELSE 4 END AS BIGINT) AS width, CAST(CASE WHEN vec_id % 50 = 0 THEN -1 ELSE 4 END AS BIGINT) AS channels,
    CASE WHEN vec_id % 50 = 0 THEN '' ELSE array_to_string(list_transform(range(0, 64), lambda i:
      printf('%02X', p[1 + 4 * (i // 4) + CASE i % 4 WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE i % 4 END])), '') END AS pixels FROM P""",
)
def image_scan(spark, sf_dir):
    """Pictures written as files and decoded; every fiftieth file is cut short."""
    one = F.lit(1.0)
    pixels = F.transform(
        "embedding",
        lambda x: F.floor((F.greatest(F.least(x.cast("double"), one), -one) + 1.0) * 127.5).cast("int"),
    )
    files = table(spark, sf_dir, "embeddings").select("vec_id", _png_of(pixels).alias("png")).select(
        F.concat(F.col("vec_id").cast("string"), F.lit(".png")).alias("path"),
        F.when(F.col("vec_id") % 50 == 0, F.substring("png", 1, 40)).otherwise(F.col("png")).alias("content"),
    )
    path = scratch_path(spark, "images")
    blobfiles.register(spark)
    files.write.format("blobfiles").mode("append").save(path)
    images = assets.read_images(spark, path)
    return images.select(
        F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("bigint").alias("vec_id"),
        "ok",
        F.col("height").cast("bigint").alias("height"),
        F.col("width").cast("bigint").alias("width"),
        F.col("channels").cast("bigint").alias("channels"),
        F.hex("data").alias("pixels"),
    )
