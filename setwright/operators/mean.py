"""Image and tensor means, and subtracting them.

A tensor is ``array<float>``, pixel-interleaved: value ``i`` belongs to channel
``i % channels``. Values are added up as vectors: per channel inside the row, per pixel in
each task over Arrow buffers. No plan has a row per pixel of the images; what is shuffled is one row
per task (and block of pixels), merged in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("global", "channel", "pixel")
# Pixels in one row of partial sums, and rows that are merged in one step of the tree: 128 MB together.
BLOCK = 8192
FAN = 1024


def with_dim_check(images: DataFrame, dims: list[str], seq: str) -> DataFrame:
    """Add ``ok``: whether the image has the dimensions of the first one."""
    shape = F.struct(*dims)
    first = images.agg(F.min_by(shape, seq).alias("first"))
    return images.withColumn("ok", F.coalesce(shape == first.scalar(), F.lit(False)))


def _channel_sums(tensor: Column, channels: int) -> Column:
    """Sum and count of each channel's values, each value looked at once."""
    size = F.size(tensor)

    def one(c: Column) -> Column:
        places = F.when(size > c, F.sequence(c, size - 1, F.lit(channels))).otherwise(F.array().cast("array<int>"))
        at = lambda i: F.get(tensor, i).cast("double")
        zero = F.lit(0.0).cast("double")
        # A null value makes the plain sum null; only then are values looked at for it.
        plain = F.aggregate(places, zero, lambda a, i: a + at(i))
        present = F.filter(places, lambda i: at(i).isNotNull())
        return F.when(plain.isNotNull(), F.struct(plain.alias("s"), F.size(places).cast("bigint").alias("n"))).otherwise(
            F.struct(F.aggregate(present, zero, lambda a, i: a + at(i)).alias("s"), F.size(present).cast("bigint").alias("n"))
        )

    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), one)


def image_channel_means(images: DataFrame, tensor: str, channels: int) -> DataFrame:
    """Per image and channel the mean, within the row."""
    keep = [c for c in images.columns if c != tensor]
    sums = _channel_sums(F.col(tensor), channels)
    per_channel = F.transform(sums, lambda x: x["s"] / (F.size(tensor) / channels))
    return images.select(*keep, F.posexplode(per_channel).alias("ch", "m"))


def _added(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the values at each place of the lists, straight from their buffers."""
    sums, counts = np.zeros(0), np.zeros(0, np.int64)
    for batch in batches:
        lists = batch.column(0)
        lists = lists.filter(lists.is_valid()) if lists.null_count else lists
        if not len(lists):
            continue
        bounds = lists.offsets.to_numpy()
        values = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        there = values.is_valid().to_numpy(zero_copy_only=False)
        flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        size = np.diff(bounds)
        width = int(size.max())
        if width > len(sums):
            sums, counts = np.pad(sums, (0, width - len(sums))), np.pad(counts, (0, width - len(counts)))
        if width and (size == width).all():
            sums[:width] += flat.reshape(-1, width).sum(axis=0)
            counts[:width] += there.reshape(-1, width).sum(axis=0)
        else:
            place = np.arange(len(flat)) - np.repeat(bounds[:-1] - bounds[0], size)
            sums[:width] += np.bincount(place, flat, width)
            counts[:width] += np.bincount(place, there, width).astype(np.int64)
    return sums, counts


def pixel_sums(images: DataFrame, tensor: str) -> DataFrame:
    """``block, s, n``: sum and count of every place of the tensors, ``BLOCK`` places to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        sums, counts = _added(batches)
        for k, at in enumerate(range(0, len(sums), BLOCK)):
            cut = [pa.array([v[at : at + BLOCK]]) for v in (sums, counts)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), *cut], names=["block", "task", "s", "n"])

    rows = images.select(F.col(tensor).cast("array<float>"))
    parts = rows.mapInArrow(run, "block int, task int, s array<double>, n array<bigint>")

    def merged(name: str, kind: str) -> Column:
        def add(a: Column, b: Column) -> Column:
            zero = F.lit(0).cast(kind)
            return F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero))

        return F.reduce(F.collect_list(name), F.array().cast(f"array<{kind}>"), add).alias(name)

    # At most FAN rows of a block meet in one step.
    both = [merged("s", "double"), merged("n", "bigint")]
    first = parts.groupBy("block", F.floor(F.col("task") / FAN).alias("lane")).agg(*both)
    return first.groupBy("block").agg(*both)


def mean_vector(images: DataFrame, tensor: str, kind: str, channels: int = 1) -> DataFrame:
    """The mean over all images as one row ``v``: of 1 value, of ``channels``, or of one image's size.

    Images must have equal dimensions (see ``with_dim_check``), so the mean of
    the images' means is the mean of their values.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    ratio = lambda s, n: F.when(n > 0, s / n)
    if kind == "pixel":
        blocks = F.sort_array(F.collect_list(F.struct("block", "s", "n")))
        flat = F.flatten(F.transform(blocks, lambda b: F.zip_with(b["s"], b["n"], ratio)))
        return pixel_sums(images, tensor).agg(flat.alias("v"))
    lanes = channels if kind == "channel" else 1
    sums = images.select(_channel_sums(F.col(tensor), lanes).alias("c"))
    total = lambda k, part: F.sum(F.get("c", k)[part])
    return sums.agg(F.array(*[ratio(total(k, "s"), total(k, "n")) for k in range(lanes)]).alias("v"))


def image_mean(images: DataFrame, tensor: str, kind: str, channels: int = 1) -> DataFrame:
    """The mean over all images: one row ``m``, rows ``(ch, m)``, or rows ``(i, m)``."""
    vector = mean_vector(images, tensor, kind, channels)
    if kind == "global":
        return vector.select(F.get("v", F.lit(0)).alias("m"))
    at = "ch" if kind == "channel" else "i"
    return vector.select(F.posexplode("v").alias(at, "m")).filter("m IS NOT NULL")


def as_vector(mean: DataFrame, kind: str) -> DataFrame:
    """The mean as one array; its length is one image's size, not the data's."""
    if "v" in mean.columns:
        return mean
    if kind == "global":
        return mean.select(F.array("m").alias("v"))
    at = "ch" if kind == "channel" else "i"
    rows = F.sort_array(F.collect_list(F.struct(at, "m")))
    return mean.agg(F.transform(rows, lambda r: r["m"]).alias("v"))


def subtract_mean(
    images: DataFrame, tensor: str, mean: DataFrame, kind: str, channels: int = 1
) -> DataFrame:
    """Replace ``tensor`` by its difference to the mean (rows of ``image_mean``, or ``mean_vector``), as float."""
    vector = as_vector(mean, kind)
    at = {
        "global": lambda i: F.lit(0),
        "channel": lambda i: i % channels,
        "pixel": lambda i: i,
    }[kind]
    with_mean = images.withColumn("_mean", vector.scalar())
    return with_mean.withColumn(
        tensor,
        F.transform(tensor, lambda x, i: (x.cast("double") - F.get("_mean", at(i))).cast("float")),
    ).drop("_mean")


def sampled_mean(
    images: DataFrame, tensor: str, kind: str, channels: int = 1, pages: int = 3, size: int = 256, seed: int = 0
) -> DataFrame:
    """The mean over a random ``pages * size`` images: a bounded sample, not the data."""
    from setwright.sources.feed import random_sample

    return image_mean(random_sample(images, pages * size, seed), tensor, kind, channels)


def save_mean(mean: DataFrame, path: str, fmt: str = "csv", kind: str | None = None) -> None:
    """Keep a mean as ``csv``, ``parquet``, or ``raw`` (little-endian float32 in one value).

    ``mean`` has the rows of ``image_mean``, or is a ``mean_vector`` of the given kind.
    """
    from setwright.functions.tensors import encode_f32

    if "v" in mean.columns:
        rows = mean.select(F.posexplode("v").alias({"channel": "ch"}.get(kind, "i"), "m"))
        mean = rows.select("m") if kind == "global" else rows

    if fmt in ("csv", "parquet"):
        mean.coalesce(1).write.mode("overwrite").format(fmt).option("header", True).save(path)
    elif fmt == "raw":
        kind = {"m": "global", "ch": "channel", "i": "pixel"}[mean.columns[0]]
        vector = as_vector(mean, kind).select(encode_f32(F.col("v").cast("array<float>")).alias("mean"))
        vector.write.mode("overwrite").parquet(path)
    else:
        raise ValueError("fmt is csv, parquet or raw")
