"""Substring deduplication by sliding runs of sentences.

A sentence ends at a word that ends in ``.``, ``!`` or ``?`` (signs may follow), or at a line break. Between
sentence bounds, a text is cut further after words that a hash of the word and the next one chooses, one in four, at least
``EDGE`` words away from any sentence bound. A cut thus depends on the few words around it and not on the length of the
sentence it lies in, so a passage is cut alike wherever it stands; sentences of up to ``2 * EDGE`` words stay whole.

Every run of at least ``SENTENCES`` sentences (or parts) with at least ``WORDS`` words counts. Equal runs are found over
all documents; of each, the occurrence with the smallest document and place stays, and every sentence that any other
occurrence covers is removed, within a document too. Hashed are, from every sentence on, the shortest run that counts, and,
up to every sentence, the shortest that counts. These cover what all runs cover: a sentence of a longer repeated run lies in
the shortest run from it on, if that ends within the longer run, and else in the shortest run up to the longer run's end.

Hashes are counted with combining before the shuffle; only the repeated ones are joined back to their
places, and each document then gets the list of its own removed runs. A passage that most documents share travels
as one row per task when counted, and as one narrow row per occurrence afterwards.

Defined results: null and empty texts, and texts with too few words, have no runs and stay as they are; a stretch
of one word repeated has no cuts inside; a null id is the smallest; an empty table gives none; rows that repeat with id and text are one occurrence and get equal rows; an
emptied text is the empty text. Words are compared with A-Z lower-cased, and white space between
words does not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setwright.llm.textarrays import SPACED, Words, byte_class, flat, mixed, slices, small_batches
from setwright.operators.joins import mark_needed
from setwright.session import staged

SENTENCES = 2
WORDS = 16
#: No cut lies closer to a sentence bound, in words.
EDGE = 4

_STOP = byte_class(lambda b: b in b".!?")
_BODY = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
_CUT = np.uint64(3)
_NEXT = np.uint64(5)
#: A run travels as its first sentence and, in the low bits, its number of sentences.
_SIZE_BITS = 20


class Sentences:
    """Sentences of a slice of texts; long ones in parts, which are called sentences too."""

    def __init__(self, texts: pa.Array):
        raw, self.offsets = flat(texts)
        self.raw = raw
        found = Words(raw, self.offsets, SPACED)
        n = len(found.start)
        size = len(raw)
        data = found.data[:size]
        at = np.arange(size, dtype=np.int64)
        last_body = np.maximum.accumulate(np.where(_BODY[data], at, -1)) if size else at
        last_stop = np.maximum.accumulate(np.where(_STOP[data], at, -1)) if size else at
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        bound = np.zeros(n + 1, dtype=bool)  # a sentence begins at the word, or ends before it
        bound[found.first] = True
        if n:
            tail = found.end - 1
            bound[1:] |= (last_stop[tail] >= found.start) & (last_stop[tail] > last_body[tail])
            bound[1:-1] |= lines[found.start[1:]] > lines[found.end[:-1]]
        self.hashes = found.hashes()
        if n > 1:
            # Cut what is long at words chosen by content, away from the bounds on both sides.
            upto = np.concatenate([[0], np.cumsum(bound)])
            here = np.arange(1, n)
            clear = upto[np.minimum(here + EDGE, n) + 1] == upto[np.maximum(here - EDGE, 0)]
            chosen = mixed(self.hashes[:-1] ^ mixed(self.hashes[1:] + _NEXT)) & _CUT == 0
            bound[1:-1] |= clear & chosen & (self.hashes[:-1] != self.hashes[1:])
        self.head = np.flatnonzero(bound[:n])  # first word of each sentence
        self.first = np.searchsorted(self.head, found.first)  # first sentence of each text
        self.byte = found.start[self.head]  # first byte of each sentence

    def find_runs(self, sentences: int = SENTENCES, words: int = WORDS) -> None:
        """Set ``run_start``, ``run_stop`` and ``run_hash``: shortest runs from each sentence on and up to each."""
        head, n = self.head, len(self.hashes)
        count = len(head)
        at = np.arange(count)
        bounds = np.append(head, n)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        to = np.maximum(np.searchsorted(bounds, head + words), at + sentences)
        to = np.where(to <= self.first[1:][text], to, -1)
        since = np.minimum(np.searchsorted(bounds, bounds[1:] - words, "right") - 1, at + 1 - sentences)
        upto = np.flatnonzero(since >= self.first[:-1][text])
        upto = upto[to[since[upto]] != upto + 1]  # else it is the shortest run from its first sentence on as well
        on = np.flatnonzero(to >= 0)
        self.run_start = np.concatenate([on, since[upto]])
        self.run_stop = np.concatenate([to[on], upto + 1])
        self.run_hash = out = np.zeros(len(self.run_start), np.uint64)
        if not count:
            return
        place = np.arange(n) - np.repeat(head, np.diff(bounds))
        each = np.add.reduceat(mixed(self.hashes ^ mixed(place.astype(np.uint64) + np.uint64(1))), head)
        live = np.arange(len(out))
        k = 0
        while len(live):
            out[live] = mixed(out[live] * np.uint64(3) + each[self.run_start[live] + k])
            k += 1
            live = live[self.run_start[live] + k < self.run_stop[live]]

    def run_texts(self) -> np.ndarray:
        """The text of each run."""
        return np.searchsorted(self.first, self.run_start, "right") - 1


def _runs(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    """One row per run: ``h``, the document's ``key`` and text hash ``t``, and ``at``, the run's place in the text."""
    if max(sentences, words) >= 1 << _SIZE_BITS:
        raise ValueError("runs are too long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = Sentences(part.column("text"))
                found.find_runs(sentences, words)
                text = found.run_texts()
                take = pa.array(text)
                at = ((found.run_start - found.first[text]) << _SIZE_BITS) + (found.run_stop - found.run_start)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.run_hash.view(np.int64)),
                        part.column("key").take(take),
                        part.column("t").take(take),
                        pa.array(at, pa.int64()),
                    ],
                    names=["h", "key", "t", "at"],
                )

    kind = docs.schema["key"].dataType.simpleString()
    return small_batches(docs).mapInArrow(run, f"h bigint, key {kind}, t bigint, at bigint")


def repeated_runs(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``key, t, runs``: per document the places of its runs that are not the first of their kind.

    ``docs`` has ``key``, ``text`` and ``t``, a hash of the text that tells apart rows with one id.
    """
    runs = _runs(docs, sentences, words)
    twice = staged(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "repeated_hashes")
    places = staged(runs.join(twice, "h").select("h", "key", "t", "at"), "repeated_places")
    place = F.struct("key", "t", "at")
    first = staged(places.groupBy("h").agg(F.min(place).alias("first")), "first_places")
    later = places.join(first, "h").filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("key", "t").agg(F.collect_set("at").alias("runs"))


def _cleaned(docs: DataFrame) -> DataFrame:
    """Remove the sentences of the listed runs from ``text``; other columns ride along in ``row``."""
    kind = docs.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                found = Sentences(texts)
                lists = part.column("runs").to_pylist()
                total, gone, out = [], [], []
                for i, runs in enumerate(lists):
                    low, high = int(found.first[i]), int(found.first[i + 1])
                    total.append(high - low)
                    if not runs:
                        gone.append(0)
                        out.append(texts[i].as_py())
                        continue
                    drop = np.zeros(high - low, dtype=bool)
                    for at in runs:
                        start = at >> _SIZE_BITS
                        drop[start : start + (at & (1 << _SIZE_BITS) - 1)] = True
                    begin, end = int(found.offsets[i]), int(found.offsets[i + 1])
                    bounds = np.append(found.byte[low:high], end)
                    kept = [found.raw[begin : bounds[0]].tobytes()]
                    kept += [found.raw[bounds[k] : bounds[k + 1]].tobytes() for k in np.flatnonzero(~drop)]
                    gone.append(int(drop.sum()))
                    out.append(b"".join(kept).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(total, pa.int32()), pa.array(gone, pa.int32()), pa.array(out, pa.string())],
                    names=["row", "n_sentences", "n_removed", "text"],
                )

    return docs.select("row", "text", "runs").mapInArrow(run, f"row {kind}, n_sentences int, n_removed int, text string")


def dedup_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: int = SENTENCES, words: int = WORDS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row: ``key``, the columns in ``keep``, ``n_sentences``, ``n_removed``, and what is left of ``text``."""
    packed = docs.select(
        F.struct(docs[key].alias("key"), *[docs[c].alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"),
        docs[key].alias("key"),
        docs[text].cast("string").alias("text"),
        F.xxhash64(docs[text].cast("string")).alias("t"),
    )
    found = repeated_runs(packed.select("key", "text", "t"), sentences, words)
    found = staged(found.select(F.col("key").alias("_key"), F.col("t").alias("_t"), "runs"), "removed_runs")
    # Only texts that lose something meet their list; the others stay where they are read.
    seen = mark_needed(packed, found.select(F.col("_key").alias("key"), F.col("_t").alias("t")), ["key", "t"], "_touched")
    touched = seen.filter("_touched").drop("_touched")
    touched = touched.join(found, touched["key"].eqNullSafe(found["_key"]) & (touched["t"] == found["_t"]), "left")
    marked = seen.filter("NOT _touched").select("row", "text", F.lit(None).cast("array<bigint>").alias("runs"))
    out = _cleaned(marked.unionByName(touched.select("row", "text", "runs")))
    return out.select(
        F.col("row.key").alias(key), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], "n_sentences", "n_removed", F.col("text").alias(text)
    )
