"""Jaccard similarity join of documents' word n-grams: a size-aware heavy-light join.

Documents with equal sets are one class; classes are compared. Two sets of sizes ``a <= b`` link when
they share at least ``needed(a, b)`` n-grams, so

* **light** sets (up to a boundary size) list all subsets of exactly that size, for each size of partner
  that can link; sets that meet in a subset link, with nothing to verify;
* **heavy** sets scan inverted lists. The lists hold the rarest n-grams of each set, as many as any
  linked pair must share one of; candidates from the lists are verified on whole sets.

The boundary is the one with the least cost over the sizes that occur: subsets listed below it,
n-grams moved above it.

What keeps the heavy side small, with nothing lost: (1) a linked pair shares at least ``share(b)`` of the
``prefix(b)`` n-grams with the smallest hashes, so classes with too few of these in common with anyone are
alone; (2) of the others, an n-gram that no other such class has counts against every link, and rare n-grams come
first in the lists; (3) each list's member with the fewest n-grams of its own is compared with all
other members first, one comparison a member, and what these links connect is not compared again: only
list members of different components whose sizes and shared n-grams allow a link are.

A group of copies is one class; a group of near copies is mostly linked by (3), so its pairs are neither
made nor compared. Minima and counts are combined before the shuffle; joins are equi-joins of
narrow rows from stored tables, which adaptive execution splits where a key is hot.

N-grams are compared by 64-bit hashes, sets by 128 bits. Defined results: null or empty texts, and texts
without words, have no n-grams and link with nothing; fewer words than ``width`` make one
n-gram; a null id is no candidate for the smallest one unless all are null; rows that repeat an id with
another text are other nodes. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setwright.llm.components import connected_components
from setwright.llm.textarrays import SPACED, Words, flat, mixed, run_hashes, slices, small_batches
from setwright.operators.joins import mark_needed, needed_only
from setwright.session import staged

#: No set of more n-grams is light, whatever the cost.
LIGHT_MOST = 32
_SECOND = np.uint64(0xD6E8FEB86659FD93)


class Threshold:
    """What a similarity of ``percent`` / 100 asks of sizes and overlaps."""

    def __init__(self, percent: int):
        self.percent = percent

    def needed(self, a: int, b: int) -> int:
        """Fewest shared n-grams with which sets of these sizes link."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def least(self, n: int) -> int:
        """Fewest shared n-grams with which a set of this size links to any, and its smallest partner's size."""
        return -(-self.percent * n // 100)

    def most(self, n: int) -> int:
        """Its largest partner's size."""
        return n * 100 // self.percent

    def share(self, n: int) -> int:
        return max(1, n // 12)

    def prefix(self, n: int) -> int:
        """How many first n-grams of a linked pair (in any fixed order) share ``share`` at least."""
        return min(n, n - self.least(n) + self.share(n))

    def listed(self, n: int, light: int) -> list[tuple[int, int, int]]:
        """Sizes ``(a, b)`` of linked pairs with ``a`` light, one of them ``n``, and the size of the subsets to list."""
        pairs = [(n, b) for b in range(n, self.most(n) + 1) if n <= light]
        pairs += [(a, n) for a in range(self.least(n), n) if a <= light]
        # Needing all of both sets means equal sets, which are one class.
        return [(a, b, c) for a, b in pairs if (c := self.needed(a, b)) <= a and not (a == b == c)]

    def subsets(self, n: int, light: int) -> int:
        return sum(comb(n, c) for _, _, c in self.listed(n, light))

    def boundary(self, sizes: dict[int, int]) -> int:
        """The light size with the least cost; ``sizes`` counts classes by size, up to the largest light partner."""
        def cost(light: int) -> int:
            listed = sum(k * self.subsets(n, light) for n, k in sizes.items())
            return listed + sum(k * (self.prefix(n) + 3 * n) for n, k in sizes.items() if n > light)

        return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


def _sets(part: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    raw, off = flat(part.column("text"))
    found = Words(raw, off, SPACED)
    hashes = found.hashes()
    grams = run_hashes(hashes, width)
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield run_hashes(hashes[a:b], b - a)
        else:
            yield grams[:0]


def _print(grams: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return mixed(grams).sum().tobytes() + mixed(grams ^ _SECOND).sum().tobytes() + len(grams).to_bytes(4, "little")


def _scanned(docs: DataFrame, width: int, take) -> DataFrame:
    """``key, fp, n`` per row and, if ``take`` says how many, its ``grams`` with the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(_sets(part, width))
                columns = [
                    part.column("key"),
                    pa.array([_print(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                ]
                if take:
                    cut = [s[: take(len(s))].view(np.int64) for s in sets]
                    bounds = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32)
                    flat_grams = np.concatenate(cut) if cut else np.empty(0, np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat_grams)))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "n", "grams"][: len(columns)])

    kind = docs.schema["key"].dataType.simpleString()
    return small_batches(docs).mapInArrow(run, f"key {kind}, fp binary, n int" + (", grams array<bigint>" if take else ""))


def _light_links(classes: DataFrame, rule: Threshold, light: int) -> DataFrame:
    """Links ``a, b`` of classes of which the smaller is light."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, n, grams in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "grams"))):
                rows = []
                grams = np.array(grams, np.int64).view(np.uint64)
                # A subset's print is the set's less what is left out.
                one, two = [int(x) for x in mixed(grams)], [int(x) for x in mixed(grams ^ _SECOND)]
                all_one, all_two = sum(one), sum(two)
                for a, b, c in rule.listed(n, light):
                    for out in combinations(range(n), n - c):
                        h1 = (all_one - sum(one[i] for i in out)) % 2**64 - 2**63
                        h2 = (all_two - sum(two[i] for i in out)) % 2**64 - 2**63
                        rows.append((a, b, h1, h2, cid, n == a))
                if rows:
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                    arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["sa", "sb", "h1", "h2", "cid", "smaller"])

    small = classes.filter(F.col("n") <= rule.most(light)).select("cid", "n", "grams")
    listed = staged(small.mapInArrow(run, "sa int, sb int, h1 bigint, h2 bigint, cid bigint, smaller boolean"), "subsets")
    # All that share the subset link with each of the smaller size; one of these stands for them.
    met = ["sa", "sb", "h1", "h2"]
    anchors = staged(listed.filter("smaller").groupBy(*met).agg(F.min("cid").alias("anchor")), "anchors")
    return listed.join(anchors, met).filter("cid != anchor").select(F.col("cid").alias("a"), F.col("anchor").alias("b")).distinct()


def _survivors(classes: DataFrame, rule: Threshold, light: int) -> DataFrame:
    """Heavy classes that have enough first n-grams in common with others."""
    heavy = classes.filter(F.col("n") > light)
    grams = heavy.select("cid", F.explode("grams").alias("gram"))
    shared = staged(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("gram"), "shared_grams")
    # Most n-grams are nobody else's and need not move.
    counts = needed_only(grams, shared, ["gram"]).join(shared, "gram").groupBy("cid").agg(F.count(F.lit(1)).alias("met"))
    least = F.ceil(rule.percent * F.col("n") / 100)
    # The partner may be smaller, and then fewer are sure to be shared.
    sure = F.greatest(F.lit(1), F.floor(least / 12))
    return staged(heavy.drop("grams").join(counts, "cid").filter(F.col("met") >= sure).select("cid", "fp", "rep", "n"), "survivors")


def _lists(sets: DataFrame, rule: Threshold) -> DataFrame:
    """Inverted lists ``gram, cid, n, own, place``: each set's rarest n-grams that others have too, rarest first."""
    grams = sets.select("cid", "n", F.explode("grams").alias("gram"))
    common = staged(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "common_grams")
    # Bounded by the number of n-grams of the document.
    shared = needed_only(grams, common, ["gram"]).join(common, "gram").groupBy("cid", "n").agg(F.collect_list(F.struct("df", "gram")).alias("shared"))
    least = F.ceil(rule.percent * F.col("n") / 100).cast("int")
    live = shared.filter(F.size("shared") >= least).withColumn("own", F.col("n") - F.size("shared"))
    # The first of n - least + 1, less those of its own, which are the rarest of all.
    first = F.slice(F.sort_array("shared"), F.lit(1), F.col("n") - least + 1 - F.col("own"))
    listed = live.select("cid", "n", "own", F.posexplode(first).alias("at", "g"))
    return staged(listed.select("cid", "n", "own", (F.col("own") + F.col("at")).alias("place"), "g.gram"), "inverted_lists")


def _possible(x: str, y: str, rule: Threshold):
    """Whether two sets have enough n-grams left to share, if the one they meet in is their first.

    In the common order (those of their own come first) nothing before the first shared n-gram is shared. A
    linked pair passes where it meets first, and there at least it is found.
    """
    needed = F.ceil(rule.percent * (F.col(f"{x}.n") + F.col(f"{y}.n")) / (100 + rule.percent))
    return F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place")) >= needed


def _verified(pairs: DataFrame, sets: DataFrame, rule: Threshold) -> DataFrame:
    """Those candidate pairs ``a, b`` whose sets link."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ga", "gb"))
    weighed = both.select("a", "b", "na", "nb", common.alias("common"))
    return staged(
        weighed.filter(100 * F.col("common") >= rule.percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "links"
    )


def _heavy_links(lists: DataFrame, sets: DataFrame, rule: Threshold) -> DataFrame:
    """Links that connect what is connected among the heavy classes."""
    hubs = staged(
        lists.groupBy("gram").agg(F.min(F.struct("own", "cid", "n", "place")).alias("hub"), F.count(F.lit(1)).alias("members"))
        .filter("members > 1").select("gram", "hub.*"),
        "hubs",
    )
    met = lists.alias("x").join(hubs.alias("y"), F.col("x.gram") == F.col("y.gram"))
    met = met.filter((F.col("x.cid") != F.col("y.cid")) & _possible("x", "y", rule))
    pairs = met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    linked = _verified(pairs, sets, rule)
    found = connected_components(linked)
    placed = lists.join(found, lists["cid"] == found["node"], "left").select("gram", "cid", "n", "place", F.coalesce("component", "cid").alias("part"))
    placed = staged(placed, "placed")
    mixed_lists = staged(
        placed.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high").select("gram"), "mixed_lists"
    )
    rest = staged(placed.join(mixed_lists, "gram"), "unlinked")
    apart = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.part") != F.col("y.part"))
    more = rest.alias("x").join(rest.alias("y"), apart & _possible("x", "y", rule))
    pairs = more.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    return linked.union(_verified(pairs, sets, rule))


def _labelled(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``fp`` and ``component_id`` of every class of the rows' sets (``key``, ``text``)."""
    rule = Threshold(percent)
    most = rule.most(LIGHT_MOST)
    # Where light sets are decided, whole sets are needed.
    seen = _scanned(rows, width, lambda n: n if n <= most else rule.prefix(n)).filter("n > 0")
    one = seen.groupBy("fp").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("grams").alias("grams"))
    # The number is pinned by writing the table.
    classes = staged(one.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # One row per size up to a constant.
    sizes = classes.filter(F.col("n") <= most).groupBy("n").count().collect()
    light = rule.boundary({r[0]: r[1] for r in sizes})
    links = _light_links(classes, rule, light)
    survivors = _survivors(classes, rule, light)
    # Texts stay where they are read; the prints decide which of the sets are asked for.
    some = needed_only(rows, survivors.select(F.col("rep").alias("key")), ["key"])
    whole = _scanned(some, width, lambda n: n).drop("key", "n")
    met = needed_only(whole, survivors, ["fp"]).join(survivors, "fp")
    sets = met.groupBy("fp").agg(F.first("cid").alias("cid"), F.first("n").alias("n"), F.first("grams").alias("grams"))
    sets = staged(sets.drop("fp"), "whole_sets")
    lists = _lists(sets, rule)
    live = sets.join(lists.select("cid").distinct(), "cid", "left_semi")
    links = links.union(_heavy_links(lists, live, rule))
    found = connected_components(links)
    linked = staged(found.join(classes.select("cid", "rep"), found["node"] == F.col("cid")).select("cid", "component", "rep"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    roots = staged(linked.join(least, "component").select(F.col("cid").alias("_cid"), "least"), "roots")
    named = classes.select("fp", "rep", "cid").join(roots, F.col("cid") == F.col("_cid"), "left")
    return staged(named.select(F.col("fp").alias("_fp"), F.coalesce("least", "rep").alias("component_id")), "labels")

def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``key``, ``n_shingles``, and ``component_id``, the smallest key it is linked with in any number of steps."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    labels = _labelled(rows, width, percent)
    again = _scanned(rows, width, None)
    out = again.join(labels, again["fp"] == labels["_fp"], "left")
    own = F.when(F.col("fp").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.col("n").cast("bigint").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the smallest key; all columns stay.

    Rows without n-grams are linked with nothing and stay. Rows that repeat key and text stay once.
    """
    def mark(frame: DataFrame):
        """Tells apart rows by key and text."""
        return F.concat_ws(":", F.coalesce(frame[key].cast("string"), F.lit("null")), F.xxhash64(frame[text].cast("string")).cast("string"))

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    labels = _labelled(rows, width, percent)
    marked = docs.select(F.struct(docs[key].alias("key"), mark(docs).alias("mark")).alias("key"), docs[text].cast("string").alias("text"))
    again = _scanned(marked, width, None)
    named = again.join(labels, again["fp"] == labels["_fp"], "left")
    first = named.filter(F.col("fp").isNull() | F.col("key.key").eqNullSafe(F.col("component_id")))
    # Of rows with one key and equal n-grams, one text.
    chosen = first.groupBy("key.key", F.coalesce("fp", F.col("key.mark").cast("binary")).alias("fp")).agg(F.min("key.mark").alias("_mark"))
    chosen = staged(chosen.select("_mark"), "chosen")
    # Texts of rows that are chosen and do not repeat, most of them, stay where they are read.
    counts = again.groupBy(F.col("key.mark").alias("_mark")).agg(F.count(F.lit(1)).alias("_rows"))
    kept = chosen.withColumn("_chosen", F.lit(True))
    doubtful = staged(counts.join(kept, "_mark", "left").filter("_chosen IS NULL OR _rows > 1").select("_mark"), "doubtful")
    seen = mark_needed(docs.withColumn("_mark", mark(docs)), doubtful, ["_mark"], "_doubtful")
    sure = seen.filter("NOT _doubtful").drop("_mark", "_doubtful")
    rest = seen.filter("_doubtful").drop("_doubtful").join(chosen, "_mark", "left_semi").dropDuplicates(["_mark"])
    return sure.unionByName(rest.drop("_mark"))
