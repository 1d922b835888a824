"""Records of JSON arrays of any size, with many tasks to one file.

A file is read as text that ends at each ``}``, which Spark splits at any byte. Where a task begins in a file, it cannot know whether it
is inside a string or how deep it is nested. But a stretch of text has a simple effect on both: it turns
"inside a string" over if it holds an odd number of quotes, and adds a number to the depth, one if it began
outside a string and another one if it began inside. Each split's effect is found on its own; running sums over a file's
splits give the state that every split begins in; with it each split is cut at the commas of the outermost
array. What is left at a split's ends is put together with its neighbours', a few short pieces per split.

Backslashes escape within one stretch only, as no escape contains a ``}``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setwright.session import staged

_PIECES = "page_file string, start bigint, n bigint, place int, text string"
# Place of a piece: a whole record, the end of one begun before, the beginning of one, or all of the split.
_WHOLE, _HEAD, _TAIL, _MIDDLE = range(4)


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quotes that are not escaped, and +1 and -1 for brackets."""
    back = data == 0x5C
    at = np.arange(len(data))
    # Place of the last byte before each one that is no backslash.
    other = np.maximum.accumulate(np.where(back, -1, at)) if len(data) else at
    before = np.concatenate([[-1], other[:-1]]) if len(data) else at
    quotes = (data == 0x22) & ((at - 1 - before) % 2 == 0)
    nesting = np.isin(data, (0x5B, 0x7B)).astype(np.int64) - np.isin(data, (0x5D, 0x7D))
    return quotes, nesting


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, bytes]]:
    """Runs of text of one split, with the ``}`` that ended each line."""
    files, starts, lines = (batch.column(c).to_pylist() for c in ("page_file", "start", "value"))
    a = 0
    for b in range(1, len(lines) + 1):
        if b == len(lines) or (files[b], starts[b]) != (files[a], starts[a]):
            yield files[a], starts[a], "".join(f"{x}}}" for x in lines[a:b]).encode()
            a = b


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split whether it turns the string state over, and the depth it adds from either state."""
    held: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for file, start, text in _stretches(batch):
            quotes, nesting = _classes(np.frombuffer(text, np.uint8))
            turned, *depths = held.setdefault((file, start), [0, 0, 0])
            inside = (np.cumsum(quotes) - quotes + turned) % 2
            for state in (0, 1):
                depths[state] += int(nesting[inside == state].sum())
            held[file, start] = [(turned + int(quotes.sum())) % 2, *depths]
    rows = [(f, s, *e) for (f, s), e in held.items()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["page_file", "start", "turns", "d0", "d1"]
    )


class _Cutter:
    """Cuts one split, from the state it begins in, at the brackets and commas of the outermost array."""

    def __init__(self, file: str, start: int, inside: int, depth: int):
        self.file, self.start, self.inside, self.depth = file, start, inside, depth
        self.open, self.n, self.rows = [], 0, []

    def add(self, text: bytes) -> None:
        data = np.frombuffer(text, np.uint8)
        quotes, nesting = _classes(data)
        state = (np.cumsum(quotes) - quotes + self.inside) % 2
        after = self.depth + np.cumsum(np.where(state == 0, nesting, 0))
        outer = (state == 0) & (
            ((data == 0x2C) & (after == 1)) | ((data == 0x5B) & (after == 1) & (nesting == 1)) | ((data == 0x5D) & (after == 0))
        )
        last = 0
        for at in np.flatnonzero(outer).tolist():
            self.open.append(text[last:at])
            self._piece(_HEAD if self.n == 0 else _WHOLE)
            self.open, last = [], at + 1
        self.open.append(text[last:])
        self.inside = (self.inside + int(quotes.sum())) % 2
        self.depth = int(after[-1]) if len(after) else self.depth

    def _piece(self, place: int) -> None:
        self.rows.append((self.file, self.start, self.n, place, b"".join(self.open).decode("utf-8", "replace")))
        self.n += 1

    def end(self) -> None:
        self._piece(_MIDDLE if self.n == 0 else _TAIL)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = None

    def out(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_file", "start", "n", "place", "text"])

    for batch in batches:
        states = {(f, s): (i, d) for f, s, i, d in zip(*(batch.column(c).to_pylist() for c in ("page_file", "start", "inside", "depth")))}
        for file, start, text in _stretches(batch):
            if cutter is None or (cutter.file, cutter.start) != (file, start):
                if cutter is not None:
                    cutter.end()
                    yield out(cutter.rows)
                cutter = _Cutter(file, start, *states[file, start])
            cutter.add(text)
            if cutter.rows:
                yield out(cutter.rows)
                cutter.rows = []
    if cutter is not None:
        cutter.end()
        yield out(cutter.rows)


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_file, start, n, body``: each element of the array in each file, as the text of an array of its own.

    ``(start, n)`` is the order in a file: the byte its split begins at, and its place there. A file's first element is what
    follows the first bracket. Text outside of the array comes as a row with no array, which ``parse_records``
    refuses as ``not_an_array``, and so does an empty element between commas.
    """
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("page_file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    effects = staged(lines.mapInArrow(_effects, "page_file string, start bigint, turns bigint, d0 bigint, d1 bigint"), "effects")
    earlier = Window.partitionBy("page_file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("turns").over(earlier), F.lit(0)), F.lit(2))
    began = effects.withColumn("inside", inside).withColumn("by", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
    states = began.select(F.col("page_file").alias("_file"), F.col("start").alias("_start"), "inside", F.coalesce(F.sum("by").over(earlier), F.lit(0)).alias("depth"))
    # One row per split, a millionth of the text.
    met = lines.join(F.broadcast(states), (F.col("page_file") == F.col("_file")) & (F.col("start") == F.col("_start"))).drop("_file", "_start")
    pieces = staged(met.mapInArrow(_cut, _PIECES), "pieces")

    # A record's beginning, what goes on through whole splits, and its end have the split it begins in in common.
    ends = pieces.filter(F.col("place") != _WHOLE)
    order = Window.partitionBy("page_file").orderBy("start", "n")
    origin = F.coalesce(F.last(F.when(F.col("place") == _TAIL, F.col("start")), True).over(order), F.lit(-1).cast("bigint"))
    joined = (
        ends.withColumn("origin", origin)
        .withColumn("origin", F.when(F.col("place") == _HEAD, F.coalesce(F.lag("origin").over(order), F.lit(-1))).otherwise(F.col("origin")))
        .groupBy("page_file", "origin")
        .agg(F.sort_array(F.collect_list(F.struct("start", "n", "text", "place"))).alias("parts"), F.max(F.when(F.col("place") == _TAIL, F.col("n"))).alias("n"))
        .select("page_file", F.col("origin").alias("start"), F.coalesce("n", F.lit(-1)).alias("n"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), F.lit(True).alias("edge"))
    )
    whole = pieces.filter(F.col("place") == _WHOLE).select("page_file", "start", "n", "text", F.lit(False).alias("edge"))
    every = whole.unionByName(joined)
    # The first and last piece of a file lie outside its array; the reader added a brace to the last.
    bounds = every.groupBy("page_file").agg(F.min(F.struct("start", "n")).alias("low"), F.max(F.struct("start", "n")).alias("high"), F.count(F.lit(1)).alias("pieces"))
    met = every.join(bounds, "page_file")
    here = F.struct("start", "n")
    outside = (here == F.col("low")) | (here == F.col("high"))
    text = F.when(here == F.col("high"), F.regexp_replace("text", r"\}$", "")).otherwise(F.col("text"))
    blank = F.trim(text, F.lit(" \t\r\n")) == ""
    empty = (F.col("pieces") == 3) & blank
    body = F.when(outside, text).when(blank, F.lit("")).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return met.filter(~((outside & blank & (F.col("pieces") > 1)) | (~outside & empty))).select("page_file", "start", "n", body.alias("body"))
