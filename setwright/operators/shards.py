"""Shards filled one after the other over a whole set: a shard is closed once it is full, and the next one starts empty.

Where a shard starts depends on where the one before it started, through the whole set. For each row as a
start the next start is the first row whose prefix sum is ``limit`` further, a search in the sorted sums. Rows lie in
ranges of bounded size. Only rows near the beginning of a range can be the first start in it, since
a shard that came from before is full by then; each of these is followed to the last start in its range and to the range where the next one
lies. That leaves a small graph, one edge per such row, and the starts on the set's own path are
found by pointer doubling: in each round every edge skips as many again, so rounds are the logarithm of the
number of ranges, and no set is walked through by one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setwright.operators.numbering import _running
from setwright.session import staged


def _following(sums: np.ndarray, limit: int) -> np.ndarray:
    """For each row the next start if a shard starts there; ``len(sums)`` past the end."""
    return np.searchsorted(sums, sums + limit, "left")


def _first_starts(sums: np.ndarray, limit: int) -> int:
    """How many rows from the beginning can be the first start in a range."""
    return min(len(sums), int(np.searchsorted(sums, sums[0] + limit, "left")) + 1)


def _walked(sums: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row as a start: the last start in the range, and how many there are."""
    n = len(sums)
    last, count, at = np.arange(n), np.ones(n, np.int64), _following(sums, limit)
    while (live := np.flatnonzero(at < n)).size:
        to = at[live]
        last[live], count[live], at[live] = last[to], count[live] + count[to], at[to]
    return last, count


def _sorted(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in the range, and sums, in order."""
    idx, sums = part.column("_idx").to_numpy(), part.column("_total").to_numpy()
    order = np.argsort(idx, kind="stable")
    return idx[order], sums[order]


def greedy_shards(
    df: DataFrame, group: str, order: Sequence[str], amount: str, limit: int, name: str = "shard"
) -> DataFrame:
    """Add the 0-based number of the shard of each row: a shard is closed once its ``amount`` has reached ``limit``.

    ``amount`` is a whole number, 0 at least (null counts as 0); ``order`` decides the order in the group, NULL is a group.
    Besides the rows, what is moved is one row per possible first start of a range.
    """
    if limit < 1:
        raise ValueError("limit is 1 at least")
    amounts = df.withColumn("_amount", F.coalesce(F.col(amount).cast("bigint"), F.lit(0).cast("bigint")))
    rows = staged(_running(amounts, group, order, "_amount", "_total"), "sums")
    kind = rows.schema[group].dataType.simpleString()
    narrow = rows.select(F.col(group).alias("_group"), "_part", "_idx", "_total")

    def edges(part: pa.Table) -> pa.Table:
        """The possible first starts, the sum at which the next start after this range lies, and the starts on the way."""
        _, sums = _sorted(part)
        last, count = _walked(sums, limit)
        k = _first_starts(sums, limit)
        keys = part.select(["_group", "_part"]).slice(0, 1)
        repeat = keys.take(pa.array(np.zeros(k, np.int64)))
        return (
            repeat.append_column("_at", pa.array(np.arange(k), pa.int64())).append_column("_sum", pa.array(sums[:k]))
            .append_column("_target", pa.array(sums[last[:k]] + limit)).append_column("_starts", pa.array(count[:k]))
            .append_column("_top", pa.array(np.full(k, sums[-1])))
        )

    shape = f"_group {kind}, _part int, _at bigint, _sum bigint, _target bigint, _starts bigint, _top bigint"
    found = staged(narrow.groupBy("_group", "_part").applyInArrow(edges, shape), "first_starts")

    # The next range with a start is the first one whose greatest sum reaches the target. The table of these
    # has an entry per range (a million rows) and group.
    ranges = found.groupBy("_group", "_part").agg(F.max("_top").alias("_top"))
    held: dict = {}
    for p, g, top in ranges.agg(F.sort_array(F.collect_list(F.struct("_part", "_group", "_top"))).alias("all")).first()["all"]:
        held.setdefault(g, ([], []))
        held[g][0].append(p)
        held[g][1].append(top)
    held = {g: (np.array(p), np.array(t)) for g, (p, t) in held.items()}

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = []
            for g, target in zip(batch.column("_group").to_pylist(), batch.column("_target").to_pylist()):
                parts, tops = held[g]
                at = int(np.searchsorted(tops, target, "left"))
                to.append(int(parts[at]) if at < len(parts) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.int32())], names=[*batch.schema.names, "_to"])

    aimed_at = found.mapInArrow(aimed, f"{shape}, _to int")
    # Within that range it is the first possible start whose sum reaches the target: the least one at or after it.
    asked = aimed_at.filter("_to IS NOT NULL").select(
        "_group", F.col("_to").alias("_part"), F.col("_target").alias("_sum"), F.lit(None).cast("bigint").alias("_at"), F.col("_part").alias("_from"), F.col("_at").alias("_from_at")
    )
    nodes = found.select("_group", "_part", "_sum", "_at", F.lit(None).cast("int").alias("_from"), F.lit(None).cast("bigint").alias("_from_at"))
    each = Window.partitionBy("_group", "_part").orderBy(F.desc("_sum"), F.desc_nulls_first("_at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # From the greatest sum down; of rows with one sum the first counts, and it comes last but for the question.
    tied = Window.partitionBy("_group", "_part", "_sum")
    both = nodes.unionByName(asked).withColumn("_here", F.min("_at").over(tied))
    met = both.withColumn("_next_at", F.min(F.when(F.col("_at").isNotNull() | F.col("_here").isNotNull(), F.col("_here"))).over(each))
    jumps = staged(
        met.filter("_from IS NOT NULL").select(
            "_group", F.col("_from").alias("_part"), F.col("_from_at").alias("_at"), F.col("_part").alias("_to"), F.col("_next_at").alias("_to_at")
        ),
        "jumps",
    )
    first = found.groupBy("_group").agg(F.min("_part").alias("_part")).withColumn("_at", F.lit(0).cast("bigint"))
    reached = staged(first, "reached")

    def hop(left: DataFrame, part: str, at: str, *keep: str) -> DataFrame:
        """Follow the jumps from ``(part, at)``."""
        j = jumps.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), F.col("_at").alias("_a"), F.col("_to").alias("_new"), F.col("_to_at").alias("_new_at"))
        same = left["_group"].eqNullSafe(j["_g"]) & (left[part] == j["_p"]) & (left[at] == j["_a"])
        return left.join(j, same).select("_group", *keep, F.col("_new"), F.col("_new_at"))

    while not jumps.isEmpty():
        further = hop(reached, "_part", "_at").select("_group", F.col("_new").alias("_part"), F.col("_new_at").alias("_at"))
        reached = staged(reached.unionByName(further).distinct(), "reached")
        twice = hop(jumps, "_to", "_to_at", "_part", "_at")
        jumps = staged(twice.select("_group", "_part", "_at", F.col("_new").alias("_to"), F.col("_new_at").alias("_to_at")), "jumps")

    # The starts of each range follow from its first one; numbers go on from range to range.
    marked = found.alias("f").join(
        reached.alias("r"), F.col("f._group").eqNullSafe(F.col("r._group")) & (F.col("f._part") == F.col("r._part")) & (F.col("f._at") == F.col("r._at"))
    ).select("f._group", "f._part", "f._at", "f._starts")
    everywhere = ranges.select("_group", "_part").alias("a").join(
        marked.alias("m"), F.col("a._group").eqNullSafe(F.col("m._group")) & (F.col("a._part") == F.col("m._part")), "left"
    ).select("a._group", "a._part", F.col("m._at").alias("_first"), F.coalesce("m._starts", F.lit(0)).alias("_starts"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    entries = staged(everywhere.withColumn("_base", F.coalesce(F.sum("_starts").over(before), F.lit(0))), "entries")
    renamed = entries.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), "_first", "_base")
    entered = narrow.join(renamed, narrow["_group"].eqNullSafe(renamed["_g"]) & (narrow["_part"] == renamed["_p"])).select("_group", "_part", "_idx", "_total", "_first", "_base")

    def numbered(part: pa.Table) -> pa.Table:
        idx, sums = _sorted(part)
        first, base = part.column("_first")[0].as_py(), part.column("_base")[0].as_py()
        begins = np.zeros(len(sums), np.int64)
        follow = _following(sums, limit)
        while first is not None and first < len(sums):
            begins[first] = 1
            first = int(follow[first])
        keys = part.select(["_group", "_part"]).take(pa.array(np.zeros(len(sums), np.int64)))
        return keys.append_column("_idx", pa.array(idx)).append_column("_shard", pa.array(base + np.cumsum(begins) - 1))

    shards = entered.groupBy("_group", "_part").applyInArrow(numbered, f"_group {kind}, _part int, _idx bigint, _shard bigint")
    # A slot (range and row number in it) is one row.
    slots = shards.select(F.col("_part").alias("_p"), F.col("_idx").alias("_i"), "_shard")
    return rows.join(slots, (rows["_part"] == slots["_p"]) & (rows["_idx"] == slots["_i"])).select(*df.columns, F.col("_shard").alias(name))
