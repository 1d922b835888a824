"""Pixels inside an export: images decoded, and the mean of all tensors subtracted.

Both replace entries of records. Only entries are moved to do so: exploded with the key of their record and their
place in it, and brought back by a join on that key. A record's entries are bounded by its feed page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setwright import schema
from setwright.functions.tensors import encode_f32
from setwright.operators.mean import mean_vector, subtract_mean
from setwright.session import scratch_path, staged
from setwright.sinks import blobfiles
from setwright.sources.assets import raw_tensors, read_images

_KEY = ("seq", "member_pos")


def _entries(records: DataFrame, kind: str) -> DataFrame:
    """The entries of one type of records without a reason: key, place ``at`` and entry ``e``."""
    good = records.filter(F.col("reason").isNull()).select(*_KEY, F.posexplode("entries").alias("at", "e"))
    return good.filter(F.col("e.type") == kind)


def _replaced(records: DataFrame, changed: DataFrame, to) -> DataFrame:
    """``records`` with the entries of ``changed`` (key, ``at``, ``defect``, ...) as ``to(entry, change)`` makes them."""
    change = F.struct(*[c for c in changed.columns if c not in (*_KEY, "at")])
    per_record = changed.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("at", change.alias("c")))).alias("_new"))
    joined = records.join(per_record, list(_KEY), "left")
    new = lambda i: F.try_element_at("_new", i)
    here = lambda e, i: F.col("_new").isNotNull() & F.map_contains_key("_new", i)
    entries = F.when(
        F.col("_new").isNotNull(), F.transform("entries", lambda e, i: F.when(here(e, i), to(e, new(i))).otherwise(e))
    ).otherwise(F.col("entries"))
    found = F.get(F.filter(F.transform(F.map_values("_new"), lambda c: c["defect"]), lambda d: d.isNotNull()), F.lit(0))
    return joined.withColumn("entries", entries).withColumn("reason", F.coalesce("reason", found)).drop("_new")


def _renamed(name: Column, digest: Column) -> Column:
    """A blob is named by its content; what follows the first dot stays."""
    return F.concat(digest, F.regexp_extract(F.coalesce(name, F.lit("")), r"\..*$", 0))


def decode_images(records: DataFrame) -> DataFrame:
    """Image entries with content become raw ``uint8`` tensors (rows of BGR pixels) with their real shape.

    The bytes are written as one file for each distinct content, as the image source reads files, and
    the pixels are joined back by digest. What is no image refuses its record (``undecodable_image``).
    """
    spark = records.sparkSession
    images = _entries(records, schema.IMAGE).filter(F.col("e.content").isNotNull())
    path = scratch_path(spark, "images")
    blobfiles.register(spark)
    named = images.select(F.col("e.digest").alias("path"), F.col("e.content").alias("content"))
    named.dropDuplicates(["path"]).write.format("blobfiles").mode("append").save(path)
    wanted = images.select(*_KEY, "at", F.col("e.digest").alias("digest"))
    if named.isEmpty():
        return records
    pixels = read_images(spark, path).select(
        F.substring_index("origin", "/", -1).alias("digest"), "height", "width", "channels", "data",
        F.when(~F.col("ok"), "undecodable_image").alias("defect"),
    )
    found = wanted.join(pixels, "digest", "left").withColumn("defect", F.when(F.col("height").isNull(), "undecodable_image").otherwise(F.col("defect")))

    def to(e: Column, c: Column) -> Column:
        digest = F.md5(c["data"])
        for name, value in (
            ("type", F.lit(schema.RAW)), ("dtype", F.lit("uint8")), ("filename", _renamed(e["filename"], digest)),
            ("channels", c["channels"]), ("width", c["width"]), ("height", c["height"]),
            ("content", c["data"]), ("digest", digest), ("n_bytes", F.octet_length(c["data"]).cast("bigint")),
        ):
            e = e.withField(name, value)
        return e

    return _replaced(records, found.drop("digest"), to)


def subtract_from(records: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Records whose raw entries are differences to the mean of all of them, and that mean as one row ``v``.

    The mean is of raw entries that have the dimensions of the first one (by record and place); an entry with others
    refuses its record (``unequal_dimensions``). Differences are ``float``. Tensors without declared
    channels have one.
    """
    raws = _entries(records, schema.RAW).select(*_KEY, "at", "e.channels", "e.width", "e.height", "e.content", "e.dtype")
    shape = F.to_json(F.struct("channels", "width", "height", F.size("tensor").alias("size")))
    tensors = staged(raw_tensors(raws).filter("tensor IS NOT NULL").select(*_KEY, "at", "channels", shape.alias("shape"), "tensor"), "pixels")
    first = tensors.agg(F.min_by(F.struct("shape", "channels"), F.struct(*_KEY, "at")).alias("s")).first()["s"]
    if first is None:
        return records, records.sparkSession.createDataFrame([], "v array<double>")
    checked = tensors.withColumn("ok", F.col("shape") == first["shape"])
    channels = first["channels"] or 1
    mean = staged(mean_vector(checked.filter("ok"), "tensor", kind, channels), "mean")
    less = subtract_mean(checked.filter("ok").select(*_KEY, "at", "tensor"), "tensor", mean, kind, channels)
    content = less.select(*_KEY, "at", encode_f32("tensor").alias("content"), F.lit(None).cast("string").alias("defect"))
    refused = checked.filter("NOT ok").select(*_KEY, "at", F.lit(None).cast("binary").alias("content"), F.lit("unequal_dimensions").alias("defect"))

    def to(e: Column, c: Column) -> Column:
        digest = F.md5(c["content"])
        for name, value in (
            ("dtype", F.lit("float")), ("filename", _renamed(e["filename"], digest)), ("content", c["content"]),
            ("digest", digest), ("n_bytes", F.octet_length(c["content"]).cast("bigint")),
        ):
            e = e.withField(name, value)
        return e

    return _replaced(records, content.unionByName(refused), to), mean
