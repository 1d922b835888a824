"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken in numpy, many texts at a time. The trees are fitted on the driver on
a bounded sample of labelled documents (``SAMPLE`` rows, those with the smallest hashed ids; only
rows that are not held out), then flattened into arrays by tree and node, so that scoring walks all trees and
a slice of documents in as many steps as a tree is deep.

Defined results: null and empty texts have statistics of 0 and get a score like any other; without
labels of both kinds the score is the share of label 1 among the sample (0.5 without any); repeated
rows get equal rows; labels that are null, or of ids that no document has, do not count. Ids, languages
and sources are never statistics. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setwright.llm.textarrays import SPACED, Words, flat, mixed, run_hashes, slices, small_batches

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE, LEAF, RIDGE = 60, 4, 64, 0.15, 20, 1.0
ACCEPT = 0.7

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&", b"!", b"?", b"|", b".,;:", b"\n", b" \t\r\x0b\x0c", b"<>{}[]()=", b"@/\\_"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = len(_CLASSES) + 1
_KINDS = len(_CLASSES) + 2

STATISTICS = (
    ["log_bytes", "log_words", "word_bytes", "word_bytes_spread", "short_words", "long_words", "distinct_words", "top_word"]
    + ["distinct_fives", "repeated_lines", "words_per_line", "marked_words", "shouted_words"]
    + [f"share_{k}" for k in range(_KINDS)]
)


def held_out(key: Column) -> Column:
    """Rows that no model learns from."""
    return F.crc32(key.cast("string")) % 4 == 2


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per text, and how often the most frequent one comes."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, t[at], counts)
    return np.bincount(t[at], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    raw, off = flat(texts)
    n = len(off) - 1
    size = np.diff(off).astype(float)
    kinds = np.bincount(np.repeat(np.arange(n) * _KINDS, np.diff(off)) + _CLASS[raw], minlength=n * _KINDS).reshape(n, _KINDS)
    found = Words(raw, off, SPACED)
    count = np.diff(found.first)
    words = count.astype(float)
    text = np.repeat(np.arange(n), count)
    length = (found.end - found.start).astype(float)
    some = np.maximum(words, 1)
    total = lambda x: np.bincount(text, weights=x, minlength=n)
    mean = total(length) / some
    spread = np.sqrt(np.maximum(total(length * length) / some - mean * mean, 0))
    hashes = found.hashes()
    distinct, top = _distinct(text, hashes, n)
    fives = run_hashes(hashes, 5)
    inside = text[: len(fives)] == text[len(text) - len(fives) :] if len(fives) else np.empty(0, bool)
    distinct_fives, _ = _distinct(text[: len(fives)][inside], fives[inside], n)
    # Lines by the sum of their words' hashes and places.
    line = np.concatenate([[0], np.cumsum(raw == 10)])[found.start] if len(found.start) else np.empty(0, np.int64)
    if len(line):
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])
        head = np.flatnonzero(new)
        place = np.arange(len(line)) - np.repeat(head, np.diff(np.append(head, len(line))))
        prints = np.add.reduceat(mixed(hashes ^ mixed(place.astype(np.uint64))), head)
        lines = np.bincount(text[head], minlength=n).astype(float)
        distinct_lines, _ = _distinct(text[head], prints, n)
        last = raw[found.end - 1]
        marked = (last < 128) & ~((last >= 48) & (last <= 57)) & ~((last | 32) >= 97) & ~np.isin(last, list(b".,;:?"))
        first = raw[found.start]
        second = raw[np.minimum(found.start + 1, found.end - 1)]
        shouted = (first >= 65) & (first <= 90) & (second >= 65) & (second <= 90) & (length > 1)
    else:
        lines = distinct_lines = np.zeros(n)
        marked = shouted = np.empty(0, bool)
    columns = [
        np.log1p(size), np.log1p(words), mean, spread, total(length <= 3) / some, total(length > 12) / some,
        distinct / some, top / some, distinct_fives / np.maximum(words - 4, 1), (lines - distinct_lines) / np.maximum(lines, 1),
        words / np.maximum(lines, 1), total(marked) / some, total(shouted) / some,
    ]
    return np.column_stack([*columns, kinds / np.maximum(size, 1)[:, None]])


class Trees:
    """Boosted trees as arrays: node ``k`` of a tree has the children ``2k + 1`` and ``2k + 2``."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature = np.zeros((0, 2**depth - 1), np.int64)
        self.limit = np.zeros((0, 2**depth - 1))
        self.leaf = np.zeros((0, 2**depth))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds; all trees walk at once."""
        n, trees = len(x), len(self.feature)
        node = np.zeros((n, trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(n)[:, None]
        for _ in range(self.depth):
            right = x[row, self.feature[tree, node]] > self.limit[tree, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[tree, node - (2**self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost trees on log loss; splits are looked for in histograms of ``bins`` quantile bins."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        model = Trees(0.0, depth)
        model.base = float(np.log((len(y) * share + 0.5) / (len(y) * (1 - share) + 0.5)))
        return model
    model = Trees(float(np.log(share / (1 - share))), depth)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    cell = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])  # cell k: at most edge k
    slot = cell + np.arange(width) * bins
    raw = np.full(n, model.base)
    leaves = 2**depth
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within its level
        feature, limit = np.zeros(leaves - 1, np.int64), np.full(leaves - 1, np.inf)
        for level in range(depth):
            nodes = 2**level
            flat_slot = (node[:, None] * (width * bins) + slot).reshape(-1)
            add = lambda v, s=flat_slot, k=nodes: np.bincount(s, weights=np.repeat(v, width), minlength=k * width * bins).reshape(k, width, bins)
            g, h, c = add(grad).cumsum(2), add(hess).cumsum(2), add(np.ones(n)).cumsum(2)
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(c < LEAF) | (ct - c < LEAF)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            worth = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            right = np.zeros(n, bool)
            for k in range(nodes):
                j, b = divmod(int(best[k]), bins)
                if worth[k] and b < len(edges[j]):
                    feature[nodes - 1 + k], limit[nodes - 1 + k] = j, edges[j][b]
                    here = node == k
                    right[here] = x[here, j] > edges[j][b]
            node = 2 * node + right
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        value = -rate * g / (h + RIDGE)
        raw += value[node]
        model.feature = np.vstack([model.feature, feature])
        model.limit = np.vstack([model.limit, limit])
        model.leaf = np.vstack([model.leaf, value])
    return model


def _statistics_of(docs: DataFrame) -> DataFrame:
    """``key`` and ``x``, the statistics of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=["key", "x"])

    kind = docs.schema["key"].dataType.simpleString()
    return small_batches(docs).mapInArrow(run, f"key {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit the trees on at most ``sample`` labelled documents that are not held out."""
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("y")).filter("key IS NOT NULL AND y IN (0, 1)")
    chosen = known.filter(~held_out(F.col("key"))).groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(sample)
    # At most ``sample`` ids and labels.
    few = F.broadcast(chosen.select(F.col("key").alias("_key"), "y"))
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    asked = rows.join(F.broadcast(chosen.select("key")), "key", "left_semi")
    found = _statistics_of(asked).join(few, F.col("key") == F.col("_key")).select(F.xxhash64("key").alias("h"), "x", "y")
    # Repeated documents could make more rows than ids.
    got = found.orderBy("h", "x").limit(sample).collect()
    x = np.array([r["x"] for r in got]).reshape(len(got), len(STATISTICS))
    return fit(x, np.array([r["y"] for r in got], float))


def scored(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = trees.score(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.float64())], names=["key", "score"])

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return small_batches(rows).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **names) -> DataFrame:
    """One row per document: ``key, held_out, score, predicted``."""
    out = scored(docs, train(docs, labels, key, **names), key)
    return out.select(
        key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay.

    Without labels of both kinds there is nothing to tell them apart by, and nothing is rejected.
    """
    names = docs.columns
    model = train(docs, labels, key)
    if not len(model.feature):
        return docs
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["text"].alias("text"))
    return scored(packed, model, "row").filter(F.col("score") >= ACCEPT).select("row.*")
