"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. Patterns are
every ``window`` consecutive words of a benchmark item, or the whole item where it has fewer words.
A shift table over hashed blocks of ``BLOCK`` words says how far the search may jump; where it says 0,
the bucket of the window's last block (the suffix) gives the patterns to test: a bucket is ordered by the hash of
all words, so a binary search finds the one to compare as text, however many share the suffix. Patterns of one length share a table, since the shortest pattern
bounds the jumps; there are ``window`` lengths at most.

The benchmark is dealt into blocks of at most ``PATTERNS_PER_BLOCK`` patterns (an item of more is a block by itself) by
running totals; the tables of each block are built in a task and written to the shared folder. One block at a time is
broadcast. With several, each makes a pass over the rows that writes the occurrences alone, its broadcast is dropped, and
the occurrences meet the texts that have any at the end.

Defined results: null and empty texts have no words and no hits; an item without words is no
pattern; items with equal windows are all named; an item without an id is a pattern like any other (all such items
count as one in ``n_items`` and add nothing to ``items_sha256``); repeated documents each get their own equal row; an
empty benchmark hits nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setwright.llm.textarrays import ALNUM, Words, flat, run_hashes, slices, small_batches
from setwright.operators.joins import mark_needed
from setwright.operators.numbering import running_totals
from setwright.session import staged

WINDOW = 10
#: Words hashed together for the shift table.
BLOCK = 2
#: Patterns in one block, which take some 100 bytes each.
PATTERNS_PER_BLOCK = 1_000_000
#: Long texts are searched as several stretches side by side.
_STRETCH = 256


class Items:
    """The words of some benchmark items, as one text with single spaces and as hashes."""

    def __init__(self, texts: pa.Array):
        raw, offsets = flat(texts)
        found = Words(raw, offsets, ALNUM)
        self.first = found.first
        self.hashes = found.hashes()
        size = found.end - found.start
        self.joined = b" ".join(found.text(0, len(size)))
        self.start = np.cumsum(size + 1) - (size + 1)
        self.end = self.start + size

    def windows(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """First words, items and length of the windows of each length."""
        counts = np.diff(self.first)
        for m in np.unique(np.minimum(counts, window)).tolist():
            if not m:
                continue
            items = np.flatnonzero(counts >= m if m == window else counts == m)
            each = counts[items] - m + 1
            nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            yield np.repeat(self.first[items], each) + nth, np.repeat(items, each), m


class Patterns:
    """Shift table and suffix buckets for the windows of one length.

    Equal windows are one pattern with all their items as ``owners``. Patterns are ordered by suffix and then by the
    hash of all words.
    """

    def __init__(self, items: Items, at: np.ndarray, item: np.ndarray, length: int):
        self.length = m = length
        self.block = b = min(BLOCK, m)
        blocks = run_hashes(items.hashes, b)
        bits = max(10, int(np.ceil(np.log2(len(at) * (m - b + 1) + 1))) + 2)
        self.mask = np.uint64((1 << bits) - 1)
        # Farthest jump that cannot pass over a pattern; least over all blocks that share a slot.
        self.shift = np.full(1 << bits, m - b + 1, dtype=np.uint8 if m < 256 else np.int64)
        for k in range(m - b, -1, -1):  # nearer ones are written later, so the least stays
            self.shift[(blocks[at + m - b - k] & self.mask).astype(np.int64)] = np.minimum(
                self.shift[(blocks[at + m - b - k] & self.mask).astype(np.int64)], k
            )
        suffix, whole = blocks[at + m - b], run_hashes_at(items.hashes, at, m)
        order = np.lexsort((item, whole, suffix))
        at, item, suffix, whole = at[order], item[order], suffix[order], whole[order]
        text = [items.joined[x:y] for x, y in zip(items.start[at].tolist(), items.end[at + m - 1].tolist())]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (suffix[1:] != suffix[:-1]) | (whole[1:] != whole[:-1])
        if any(text[k] != text[k - 1] for k in np.flatnonzero(~new).tolist()):
            # Different windows of one hash: order such a bucket by text as well, and keep them apart.
            group = np.cumsum(new)
            order = np.array(sorted(range(len(at)), key=lambda k: (group[k], text[k], item[k])))
            at, item, suffix, whole = at[order], item[order], suffix[order], whole[order]
            text = [text[k] for k in order.tolist()]
            new[1:] |= [x != y for x, y in zip(text[1:], text)]
        self.starts = np.flatnonzero(new)
        self.suffix, self.whole = suffix[self.starts], whole[self.starts]
        self.texts = [text[k] for k in self.starts.tolist()]
        self.owner = item.astype(np.int32)
        self.owner_ends = np.append(self.starts[1:], len(at))

    def owners(self, pattern: int) -> list[int]:
        """Numbers of the items that have a pattern."""
        return self.owner[self.starts[pattern] : self.owner_ends[pattern]].tolist()

    def search(self, found: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word index of each occurrence, and its pattern."""
        m, b = self.length, self.block
        none = np.empty(0, np.int64)
        blocks = run_hashes(hashes, b)
        counts = np.diff(found.first)
        # Each stretch starts every _STRETCH words and looks for windows that start in it.
        texts = np.flatnonzero(counts >= m)
        if not len(texts):
            return none, none
        per = -(-(counts[texts] - m + 1) // _STRETCH)
        text = np.repeat(texts, per)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        at = found.first[text] + nth * _STRETCH
        stop = np.minimum(at + _STRETCH, found.first[text] + counts[text] - m + 1)
        hits = []
        last = m - b  # where the last block of a window starts
        while len(at):
            jump = self.shift[(blocks[at + last] & self.mask).astype(np.int64)]
            zero = at[jump == 0]
            if len(zero):
                hits.append(zero)
            at = at + np.maximum(jump.astype(np.int64), 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not hits:
            return none, none
        at = np.concatenate(hits)
        tail = blocks[at + last]
        low = np.searchsorted(self.suffix, tail, "left")
        size = np.searchsorted(self.suffix, tail, "right") - low
        at, low, size = at[size > 0], low[size > 0], size[size > 0]
        if not len(at):
            return none, none
        full = run_hashes_at(hashes, at, m)
        high = low + size
        low, high = least(self.whole, low, high, full), high
        where, which = [], []
        # Patterns of one hash in turn: one, unless hashes of different windows are equal.
        while True:
            same = (low < high) & (self.whole[np.minimum(low, len(self.whole) - 1)] == full)
            at, low, high, full = at[same], low[same], high[same], full[same]
            if not len(at):
                break
            where.append(at)
            which.append(low)
            low = low + 1
        if not where:
            return none, none
        where, which = np.concatenate(where), np.concatenate(which)
        sure = [b" ".join(found.text(w, w + m)) == self.texts[p] for w, p in zip(where.tolist(), which.tolist())]
        sure = np.array(sure, dtype=bool)
        return where[sure], which[sure]


def least(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first place of each range ``low`` to ``high - 1`` of ``values``, ordered there, that is not below ``wanted``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        below = open_ & (values[np.minimum(middle, len(values) - 1)] < wanted)
        low = np.where(below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def run_hashes_at(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """One hash of the ``length`` word hashes from each place on."""
    out = np.zeros(len(at), np.uint64)
    for k in range(length):
        out = run_hashes(np.stack([out, hashes[at + k]], 1).reshape(-1), 2)[::2] if len(at) else out
    return out


def in_order(items: set[str | None]) -> list[str | None]:
    """Ids sorted, a null one first."""
    return sorted(items, key=lambda i: (i is not None, i or ""))


def tables(texts: pa.Array, window: int) -> list[Patterns]:
    """Search tables, one per pattern length, for some items."""
    items = Items(texts)
    return [Patterns(items, at, item, m) for at, item, m in items.windows(window)]


def block_tables(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """``block, found``: the pickled ids and search tables of each block of items, each made in one task and staged."""
    items = benchmark.select(benchmark[item].cast("string").alias("item"), benchmark[text].cast("string").alias("text"))
    sized = items.distinct().select(
        "*",
        F.lit(0).alias("all"),
        F.xxhash64("text").alias("t"),
        (F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 2) + 1).alias("size"),  # words, and so windows, at most
    )
    placed = running_totals(staged(sized, "benchmark_items"), "all", ["item", "t"], "size")
    dealt = placed.select(F.floor(F.col("total_before") / PATTERNS_PER_BLOCK).alias("block"), "item", "text")

    def build(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        texts = pa.concat_arrays([pa.array([], pa.string()), *[c.cast(pa.string()) for c in part.column("text").chunks]])
        made = pickle.dumps((part.column("item").to_pylist(), tables(texts, window)))
        return pa.table({"block": part.column("block").slice(0, 1), "found": pa.array([made], pa.binary())})

    return staged(dealt.groupBy("block").applyInArrow(build, "block bigint, found binary"), "benchmark_blocks")


HITS = "key {key}, text string, n_words bigint, items array<string>, starts array<int>, sizes array<int>"


def _pass(docs: DataFrame, found_tables, kind: str) -> DataFrame:
    """Add one benchmark block's occurrences to each row; without a block, the numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, search = pickle.loads(found_tables.value) if found_tables else ([], [])
        for batch in batches:
            for part in slices(batch, "text"):
                raw, off = flat(part.column("text"))
                found = Words(raw, off, ALNUM)
                hashes = found.hashes()
                items = [set(x or ()) for x in part.column("items").to_pylist()]
                starts, sizes = part.column("starts").to_pylist(), part.column("sizes").to_pylist()
                for patterns in search:
                    where, which = patterns.search(found, hashes)
                    texts = np.searchsorted(found.first, where, "right") - 1
                    for t, w in zip(texts.tolist(), where.tolist()):
                        starts[t].append(w - int(found.first[t]))
                        sizes[t].append(patterns.length)
                    for t, p in set(zip(texts.tolist(), which.tolist())):
                        items[t].update(names[k] for k in patterns.owners(p))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("text"),
                        pa.array(np.diff(found.first), pa.int64()),
                        pa.array([in_order(i) for i in items], pa.list_(pa.string())),
                        pa.array(starts, pa.list_(pa.int32())),
                        pa.array(sizes, pa.list_(pa.int32())),
                    ],
                    names=["key", "text", "n_words", "items", "starts", "sizes"],
                )

    return small_batches(docs).mapInArrow(run, HITS.format(key=kind))


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Every occurrence of a benchmark window in each row of ``docs``.

    Returns ``key``, ``text``, ``n_words``, ``items`` (sorted ids as text, each once, a null one first), and ``starts`` and ``sizes``:
    first word and number of words of each occurrence.
    """
    spark = docs.sparkSession
    found = {
        "n_words": F.lit(None).cast("bigint"),
        "items": F.array().cast("array<string>"),
        "starts": F.array().cast("array<int>"),
        "sizes": F.array().cast("array<int>"),
    }
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    fresh = rows.withColumns(found)
    kind = rows.schema["key"].dataType.simpleString()
    blocks = block_tables(benchmark, item, item_text, window)
    numbers = sorted(r.block for r in blocks.select("block").collect())  # one number a block

    def sent(number: int):
        return spark.sparkContext.broadcast(bytes(blocks.filter(F.col("block") == number).first().found))

    if len(numbers) <= 1:
        return _pass(fresh, sent(numbers[0]) if numbers else None, kind).withColumnRenamed("key", key)
    passes = []
    for number in numbers:
        tables_sent = sent(number)
        hits = _pass(fresh, tables_sent, kind).filter(F.size("starts") > 0)
        hits = hits.withColumn("t", F.xxhash64("text")).select("key", "t", "items", "starts", "sizes").dropDuplicates(["key", "t"])
        passes.append(staged(hits, "benchmark_hits"))
        tables_sent.destroy()
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "sizes")]
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))), _null_first)
    together = reduce(DataFrame.unionAll, passes).groupBy("key", "t").agg(names.alias("items"), *lists)
    together = staged(together.select(F.col("key").alias("_key"), F.col("t").alias("_t"), "items", "starts", "sizes"), "benchmark_found")
    # Only texts with occurrences meet them; the others stay where they are read.
    seen = rows.withColumn("t", F.xxhash64("text"))
    seen = mark_needed(seen, together.select(F.col("_key").alias("key"), F.col("_t").alias("t")), ["key", "t"], "_hit")
    touched = seen.filter("_hit")
    touched = touched.join(together, touched["key"].eqNullSafe(together["_key"]) & (touched["t"] == together["_t"]), "left")
    touched = touched.select(
        "key", "text", found["n_words"].alias("n_words"), *[F.coalesce(c, found[c]).alias(c) for c in ("items", "starts", "sizes")]
    )
    out = touched.unionByName(seen.filter("NOT _hit").select("key", "text").withColumns(found))
    return _pass(out, None, kind).withColumnRenamed("key", key)


def _null_first(a, b):
    """Order of ids, a null one first."""
    both = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).otherwise(both).cast("int")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", **names) -> DataFrame:
    """One row per document: ``n_words``, ``n_hit`` words inside any occurrence, and the items found.

    Also ``items_sha256`` (of the sorted ids, comma-joined), ``n_items`` and ``contaminated`` (any hit).
    """
    found = occurrences(docs, benchmark, window, key=key, **names).withColumnRenamed(key, "key")
    kind = found.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sizes = batch.column("starts").to_pylist(), batch.column("sizes").to_pylist()
            items = batch.column("items").to_pylist()
            hit = [covered(s, z) for s, z in zip(starts, sizes)]
            digests = [hashlib.sha256(",".join(x for x in i if x is not None).encode()).hexdigest() for i in items]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("n_words"),
                    pa.array(hit, pa.int64()),
                    pa.array([len(i) for i in items], pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                ],
                names=["key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    schema = f"key {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return found.drop("text").mapInArrow(run, schema).withColumnRenamed("key", key)


def covered(starts: list[int], sizes: list[int]) -> int:
    """How many words lie in any of some spans."""
    total = reached = 0
    for start, size in sorted(zip(starts, sizes)):
        total += max(0, start + size - max(start, reached))
        reached = max(reached, start + size)
    return total


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows in which any benchmark window occurs; all columns stay."""
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["text"].alias("text"))
    found = occurrences(packed, benchmark, window, key="row")
    return found.filter(F.size("starts") == 0).select("row.*")
