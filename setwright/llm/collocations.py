"""Phrase collocations per language, by top-order marginalisation.

Every word occurrence opens one window of ``most`` words: the word and lead columns with the words after it, padded
past the end of its piece. Only these longest windows are counted from the texts. Every shorter phrase
is the prefix of the windows that begin with it, so a ``ROLLUP`` over the counted windows sums them to the counts of all
shorter phrases, of single words and of all words of a language. No n-gram of another length is exploded.

Most windows of a large corpus occur once and can be no part of a phrase with ``least`` occurrences. So a pass for
each length up to ``most`` first counts the windows of that length by the bucket their hash falls in; where a bucket stays
below ``least``, so do its phrases, and lead columns hold a marker instead of the word that would complete one. Windows
then fall together before they are shuffled. Only phrases whose own parts were frequent enough are counted by the next pass. The
table of a length has ``2 ** FILTER_BITS`` bits (16 MB) for any input: with very many frequent phrases it
prunes less, and the counts are the same, since what passes is counted by its words. The counters travel as
packed runs of 3 bytes a bucket and are added up in tasks that hold one byte a bucket.

Windows are combined in each slice of text, in each task and where they meet, so a word, pair or language that a
third of all rows share is a handful of partial sums. The first phrases of a language are chosen in slots of bounded size,
again and again until one slot is left.

Scores are exact: counts are multiplied as ``decimal(38, 0)``, which holds the scale and a product of two counts up to 10^16.

Defined results: a null text is empty; a null language is ``und`` (one with a language of that name); repeated rows count
again; an empty table has no phrases. A text longer than a slice is read in stretches of whole
words that overlap by a window, so memory follows the slice and the longest word. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setwright.llm.textarrays import SLICE_BYTES, Words, byte_class, flat, mixed, slices, small_batches
from setwright.session import staged

FILTER_BITS = 27
_ROW_BITS = 15
#: Windows whose buckets a task holds before it packs them.
_HELD = 1 << 23
_BREAKS = byte_class(lambda b: chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D)
_WORD = byte_class(lambda b: b not in (0x20, 0x09) and not _BREAKS[b])
#: Stands for words that are no part of a candidate, and for padding. No word holds a blank.
_NONE = " "
#: Rows that one task ranks.
_SLOT_ROWS = 200_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def stretches(raw: np.ndarray, offsets: np.ndarray, most: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``bytes, text offsets, own``: windows that begin before byte ``own`` belong to the stretch.

    Texts of a slice come as they are; a text longer than ``limit`` is cut at bytes outside words, and each
    stretch goes on for the ``most - 1`` words after it.
    """
    if len(offsets) != 2 or len(raw) <= limit:
        yield raw, offsets, len(raw)
        return
    start = 0
    while start < len(raw):
        own = start + limit
        gap = np.flatnonzero(~_WORD[raw[own:]])[:1] if own < len(raw) else []
        own = own + int(gap[0]) if len(gap) else len(raw)
        end, more = own, 1 << 12
        while end < len(raw):
            end = min(len(raw), own + more)
            inside = _WORD[raw[own:end]]
            # The end of the last word that is looked at must be seen too.
            if np.count_nonzero(inside[:-1] & ~inside[1:]) >= most - 1:
                break
            more *= 2
        part = raw[start:end]
        yield part, np.array([0, len(part)]), own - start
        start = own


class _Windows:
    """Words of a stretch, and how far the window of each one reaches in its piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, own: int):
        words = Words(raw, offsets, _WORD)
        self.words = words
        self.own = int(np.searchsorted(words.start, own))
        n = len(words.start)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
        breaks = np.concatenate([[0], np.cumsum(_BREAKS[raw])])
        piece = breaks[words.start] if n else np.empty(0, np.int64)
        #: Whether the next word is in the same piece.
        self.joined = np.zeros(n, bool)
        if n > 1:
            self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])

    def buckets(self, salt: np.ndarray, size: int) -> np.ndarray:
        """The bucket of each window of ``size`` words; ``salt`` has a number for the language of each text."""
        h = self.words.hashes()
        out = h ^ salt[self.text]
        for k in range(1, size):
            out = mixed(out) + np.concatenate([h[k:], h[:k]]) * _SPREAD
        return (mixed(out) >> np.uint64(64 - FILTER_BITS)).astype(np.int32)

    def possible(self, salt: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
        """For the sizes from 2 to that after the last table: which windows may be frequent by the tables of smaller ones.

        A window that a table rules out is ruled out in the masks from the next size on.
        """
        out = [self.joined]
        for size, bits in enumerate(tables, 2):
            place = self.buckets(salt, size)
            live = out[-1] & ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
            out[-1] = live
            out.append(live & np.concatenate([live[1:], [False]])[: len(live)])
        return out

    def strings(self) -> pa.Array:
        data, start, end = self.words.data, self.words.start, self.words.end
        edge = np.zeros(len(data) + 1, np.int8)
        edge[start] += 1
        edge[end] -= 1
        body = data[np.cumsum(edge[:-1]) > 0]
        at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body)))


def _languages(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """The language of each row as an index, and the languages."""
    coded = part.column("lang").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _salts(names: pa.Array) -> np.ndarray:
    import hashlib

    of = [hashlib.blake2b(x.encode(), digest_size=8).digest() for x in names.to_pylist()]
    return np.array([int.from_bytes(x, "little") for x in of], np.uint64)


def _seen(batches: Iterator[pa.RecordBatch], most: int, limit: int) -> Iterator[tuple[_Windows, np.ndarray, np.ndarray, pa.Array]]:
    for batch in batches:
        for part in slices(batch, "text", limit):
            index, names = _languages(part)
            salt = _salts(names)[index] if len(names) else np.empty(0, np.uint64)
            for raw, offsets, own in stretches(*flat(part.column("text")), most, limit):
                yield _Windows(raw, offsets, own), salt, index, names


def _packed(places: np.ndarray, least: int) -> pa.RecordBatch:
    """Counts by bucket, as one row for each run of buckets: places in the run, and counts up to ``least``."""
    found, counts = np.unique(places, return_counts=True)
    rows = found >> _ROW_BITS
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    ends = np.append(first, len(found)).astype(np.int32)

    def runs(values: np.ndarray) -> pa.Array:
        at = pa.py_buffer(ends * values.itemsize)
        return pa.Array.from_buffers(pa.binary(), len(first), [None, at, pa.py_buffer(values.tobytes())])

    low = (found & ((1 << _ROW_BITS) - 1)).astype(np.uint16)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[first].astype(np.int32)), runs(low), runs(np.minimum(counts, least).astype(_counter(least)))], names=["row", "places", "counts"]
    )


def _counter(least: int):
    return np.uint8 if least < 256 else np.uint32


def _frequent_buckets(rows: DataFrame, most: int, least: int, limit: int, before: list) -> np.ndarray:
    """A bit for each bucket whose windows occur ``least`` times together; the size follows the tables of smaller ones."""
    size = len(before) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [t.value for t in before]
        held, n = [], 0
        for seen, salt, _, _ in _seen(batches, most, limit):
            held.append(seen.buckets(salt, size)[: seen.own][seen.possible(salt, tables)[-1][: seen.own]])
            n += len(held[-1])
            if n >= _HELD:
                yield _packed(np.concatenate(held), least)
                held, n = [], 0
        if n:
            yield _packed(np.concatenate(held), least)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, sums = _counter(least), {}
        for batch in batches:
            for row, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                of = sums.setdefault(row, np.zeros(1 << _ROW_BITS, kind))
                at = np.frombuffer(places, np.uint16)
                of[at] = np.minimum(of[at].astype(np.int64) + np.frombuffer(counts, kind), least)
        for row, of in sums.items():
            bits = np.packbits(of >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([bits], pa.binary())], names=["row", "bits"])

    packed = rows.mapInArrow(count, "row int, places binary, counts binary").repartition("row")
    # At most 2 ** (FILTER_BITS - _ROW_BITS) rows of 4 KB, whatever the input.
    table = np.zeros((1 << (FILTER_BITS - _ROW_BITS), 1 << (_ROW_BITS - 3)), np.uint8)
    for row, bits in packed.mapInArrow(add, "row int, bits binary").collect():
        table[row] = np.frombuffer(bits, np.uint8)
    return table.ravel()


def windows(rows: DataFrame, most: int, least: int, limit: int = SLICE_BYTES) -> DataFrame:
    """``lang, w1 .. w<most>, n``: windows of every word, equal ones together.

    A lead column past the end of the piece, or past words that are too rare together, holds the marker. The columns
    travel as one text, which is a third shorter than several.
    """
    tables = []
    for _ in range(2, most + 1):
        tables.append(rows.sparkSession.sparkContext.broadcast(_frequent_buckets(rows, most, least, limit, tables)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [t.value for t in tables]
        for seen, salt, index, langs in _seen(batches, most, limit):
            if not seen.own:
                continue
            words, at = seen.strings(), np.arange(seen.own)
            leads = [words.slice(0, seen.own)]
            for k, reach in enumerate(seen.possible(salt, bits)[: most - 1], 1):
                leads.append(words.take(pa.array(np.where(reach[: seen.own], at + k, 0), mask=~reach[: seen.own])))
            window = pc.binary_join_element_wise(*leads, pa.scalar(" ", pa.large_string()), null_handling="skip")
            lang = pa.DictionaryArray.from_arrays(pa.array(index[seen.text[: seen.own]]), langs).cast(pa.string())
            counted = pa.table([lang, window], names=["lang", "window"]).group_by(["lang", "window"]).aggregate([([], "count_all")])
            out = counted.select(["lang", "window", "count_all"]).rename_columns(["lang", "window", "n"])
            yield from out.cast(pa.schema([("lang", pa.string()), ("window", pa.string()), ("n", pa.int64())])).to_batches()

    counts = rows.mapInArrow(run, "lang string, window string, n bigint").groupBy("lang", "window").agg(F.sum("n").alias("n"))
    words = F.split("window", " ")
    return counts.select("lang", *[F.coalesce(F.get(words, k), F.lit(_NONE)).alias(f"w{k + 1}") for k in range(most)], "n")


def phrase_counts(docs: DataFrame, most: int = 3, least: int = 10, text: str = "text", lang: str = "lang", limit: int = SLICE_BYTES) -> DataFrame:
    """``lang, w1 .. w<most>, f``: all words of a language, and its words and phrases that occur ``least`` times.

    A shorter phrase has nulls past its end; in the count of all words ``w1`` is null too.
    """
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("string").alias("text"))
    w = [f"w{i}" for i in range(1, most + 1)]
    top = windows(small_batches(rows), most, least, limit).withColumnRenamed("n", "f")
    # Windows too rare for candidates only count for their prefixes.
    last = F.when(F.col("f") < least, F.lit(_NONE)).otherwise(F.col(w[-1]))
    summed = top.select("lang", *w[:-1], last.alias(w[-1]), "f").rollup("lang", *w).agg(F.sum("f").alias("f"))
    real = F.col("lang").isNotNull() & (F.col("w1").isNull() | (F.col("f") >= least))
    for x in w:
        real = real & (F.col(x).isNull() | (F.col(x) != _NONE))
    return summed.filter(real)


def _first(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """Add ``rank``, up to ``most``, within each group, without a task that sorts a whole group."""
    while (slots := -(-rows.count() // _SLOT_ROWS)) > 1:
        slot = F.pmod(F.xxhash64("phrase"), F.lit(slots))
        each = Window.partitionBy(group, slot).orderBy(*order)
        kept = rows.withColumn("_rank", F.row_number().over(each)).filter(F.col("_rank") <= most).drop("_rank")
        before, rows = rows, staged(kept, "first_phrases")
        if rows.count() > before.count() // 2:
            break  # as many languages as that leave little in each
    each = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= most)


def collocations(
    docs: DataFrame, most: int = 3, least: int = 10, covered: int = 50, first: int = 2000, scale: int = 1_000_000, text: str = "text", lang: str = "lang",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """The ``first`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of 2 to ``most`` words with ``a >= least`` occurrences scores ``floor(scale * a * a / (l * r))`` at the cut that
    gives least (then the first such), ``l`` and ``r`` being the counts of what stands before and after the cut. A
    phrase within a longer one that has ``covered`` percent of its occurrences or more is left out.
    """
    counts = staged(phrase_counts(docs, most, least, text, lang, limit), "phrase_counts")
    w = F.filter(F.array(*[f"w{i}" for i in range(1, most + 1)]), lambda x: x.isNotNull())
    phrases = counts.filter("w1 IS NOT NULL").select("lang", w.alias("w"), F.col("f").alias("a"))
    parts = phrases.filter(F.size("w") < most).select("lang", F.array_join("w", " ").alias("part"), F.col("a").alias("f"))
    found = staged(phrases.filter(F.size("w") > 1).select("lang", "w", F.array_join("w", " ").alias("phrase"), "a"), "phrases")

    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    cuts = found.select("lang", "phrase", "a", "w", cut)
    head, tail = F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", head.alias("head"), tail.alias("tail"))
    left = parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r"))
    d = lambda x: F.col(x).cast("decimal(18,0)")
    score = F.call_function("div", (d("a") * d("a")).cast("decimal(38,0)") * F.lit(scale).cast("decimal(7,0)"), d("l") * d("r"))
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"])
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("bigint").alias("score"), "k", "l", "r")).alias("cut"))

    size = F.col("size")
    longer = found.filter(F.size("w") > 2).select("lang", "w", "a", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    longer = longer.select("lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    inner = longer.select("lang", F.array_join(F.slice("w", F.col("i"), size), " ").alias("phrase"), "a")
    cover = inner.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    open_ = lowest.join(cover, ["lang", "phrase"], "left").filter(F.col("cover").isNull() | (100 * F.col("cover") < covered * F.col("a")))
    kept = staged(open_.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "collocations")

    ranked = _first(kept, "lang", [F.desc("score"), F.desc("a"), "phrase"], first)
    totals = counts.filter("w1 IS NULL").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
