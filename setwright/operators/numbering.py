"""Positions, running totals and dense ids without a one-task window.

A window with no partition keys, or one partitioned by the export set (which may
hold most rows), sorts everything in one task. Here rows are range-partitioned
on a total order instead, written once to the shared folder with their slot
(partition number and place in it), and numbered by adding a per-partition
offset. The only thing that is broadcast has one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setwright.operators.joins import lookup_join
from setwright.session import staged

# monotonically_increasing_id() keeps the partition number above the low 33 bits.
_SLOT_BITS = 33
# Rows, and bytes of them, that one task sorts; the one that is reached first counts.
ROWS_PER_PARTITION = 1_000_000
BYTES_PER_PARTITION = 128 * 1024 * 1024
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def _wide_bytes(df: DataFrame) -> list[Column]:
    """Per column whose values have no fixed width, the bytes of a value; structs and maps are counted as JSON."""
    sizes = []
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, _FIXED):
            continue
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(column)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, _FIXED):
            size = F.when(column.isNotNull(), F.size(column) * 8)
        else:
            size = F.octet_length(F.to_json(F.struct(column)))
        sizes.append(F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")))
    return sizes


def _ranges(df: DataFrame, rows: int | None) -> int:
    """How many tasks are to sort ``df``: by its rows, and by its bytes if any column may be wide."""
    wide = _wide_bytes(df)
    if rows is not None and not wide:
        return max(1, -(-rows // ROWS_PER_PARTITION))
    size = F.coalesce(F.sum(reduce(add, wide)), F.lit(0)) if wide else F.lit(0)
    seen = df.agg(F.count(F.lit(1)).alias("n"), size.alias("b")).first()
    return max(1, -(-seen["n"] // ROWS_PER_PARTITION), -(-seen["b"] // BYTES_PER_PARTITION))


def in_order(df: DataFrame, order: Sequence[str], rows: int | None = None, amount: str | None = None) -> DataFrame:
    """Stage ``df`` range-partitioned by ``order``, with its slot in ``_part`` and ``_idx``.

    Rows that tie in ``order`` stay apart: they have different slots, in any order. As long as few tie, ranges
    stay even when a leading column (the set) has one hot value. The number of
    ranges follows the rows and their bytes. ``amount`` adds ``_run``, its sum over the earlier rows of the range.
    """
    slots = (
        df.repartitionByRange(_ranges(df, rows), *order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    if amount is not None:
        slots = _with_run(slots, amount)
    return (
        staged(slots, "ordered")
        .withColumn("_part", F.shiftright("_slot", _SLOT_BITS).cast("int"))
        .withColumn("_idx", F.col("_slot").bitwiseAND((1 << _SLOT_BITS) - 1))
        .drop("_slot")
    )


def _with_run(rows: DataFrame, amount: str) -> DataFrame:
    """Add the sum of ``amount`` (whole numbers or doubles; null is 0) over the rows before each one in its task."""
    kind = "double" if rows.schema[amount].dataType.typeName() in ("double", "float") else "bigint"
    asked = rows.withColumn("_run", F.coalesce(F.col(amount).cast(kind), F.lit(0).cast(kind)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            values = batch.column("_run").to_numpy()
            total = np.cumsum(values)
            at = batch.schema.get_field_index("_run")
            yield batch.set_column(at, "_run", pa.array(total - values + before))
            before += total[-1] if len(total) else 0

    return asked.mapInArrow(run, fields)


def _before(ordered: DataFrame, amount: Column, name: str) -> DataFrame:
    """Per partition, the total of ``amount`` over all earlier partitions; one row per partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ordered.groupBy("_part")
        .agg(amount.alias("_amount"))
        .select("_part", F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias(name))
    )


def row_positions(
    df: DataFrame, order: Sequence[str], name: str = "position", rows: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in ``order`` over the whole table; rows that tie come in any order.

    Rows are sorted once, as a whole, and keep their slot, so none is looked for by its values again.
    """
    ordered = in_order(df, order, rows)
    base = F.broadcast(_before(ordered, F.count(F.lit(1)), "_base"))
    return ordered.join(base, "_part").select(*df.columns, (F.col("_base") + F.col("_idx")).alias(name))


def group_positions(
    df: DataFrame, group: str, order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Add the 0-based position of each row within its group, however large the group is; NULL is a group."""
    placed = staged(row_positions(df, [group, *order], "_global"), "placed")
    starts = placed.groupBy(group).agg(F.min("_global").alias("_start"))
    return lookup_join(placed, starts, [group], null_safe=True).select(
        *df.columns, (F.col("_global") - F.col("_start")).alias(name)
    )


def _running(df: DataFrame, group: str, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """``df`` with ``_part``, ``_idx`` and the sum of ``amount`` over the earlier rows of the group."""
    ordered = in_order(df, [group, *order], amount=amount)
    # A row per range, and one more per group. All that follows is small but the join of the rows, which
    # adaptive execution makes a broadcast join.
    cells = ordered.groupBy(group, "_part").agg(F.coalesce(F.sum(amount), F.lit(0)).alias("_sum"), F.min_by("_run", "_idx").alias("_first"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cells.groupBy("_part").agg(F.sum("_sum").alias("_sum"))
    base = parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    placed = cells.join(base, cells["_part"] == base["_p"]).select(F.col(group).alias("_group"), "_p", "_base", (F.col("_base") + F.col("_first")).alias("_at"))
    # Amounts may be negative, so a group starts with the total at its first row, not the least one.
    starts = placed.groupBy("_group").agg(F.min_by("_at", "_p").alias("_start")).withColumnRenamed("_group", "_g")
    offsets = placed.join(starts, placed["_group"].eqNullSafe(starts["_g"])).select("_group", "_p", (F.col("_base") - F.col("_start")).alias("_offset"))
    met = ordered.join(offsets, (ordered["_part"] == offsets["_p"]) & ordered[group].eqNullSafe(offsets["_group"]))
    return met.select(*df.columns, "_part", "_idx", (F.col("_run") + F.col("_offset")).alias(name))


def running_totals(
    df: DataFrame, group: str, order: Sequence[str], amount: str, name: str = "total_before"
) -> DataFrame:
    """Add the sum of ``amount`` over the earlier rows of the same group; NULL is a group."""
    return _running(df, group, order, amount, name).select(*df.columns, name)


def dense_ids(
    df: DataFrame,
    value: str,
    seq: Sequence[str],
    name: str = "category_id",
    start: int = 0,
    known: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct value with ids in order of first appearance.

    The first appearance is a map-side-combined minimum, so a value that most
    rows share travels as one row per task; only distinct values are compared
    with the ``known`` ones (which get no new id) and ordered.
    """
    firsts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.min(F.struct(*seq)).alias("_first"))
    )
    if known is not None:
        firsts = firsts.join(known.select(value).distinct(), value, "left_anti")
    firsts = staged(firsts, "firsts")
    flat = firsts.select(value, *[F.col("_first")[c].alias(f"_s{i}") for i, c in enumerate(seq)])
    keys = [f"_s{i}" for i in range(len(seq))]
    return row_positions(flat, [*keys, value], "_pos").select(
        value, (F.col("_pos") + start).cast("bigint").alias(name)
    )


def batch_numbers(df: DataFrame, order: Sequence[str], size: int, name: str = "batch_id") -> DataFrame:
    """Add the number of the fixed-size batch each row falls into."""
    numbered = row_positions(df, order, "_position")
    return numbered.select(*df.columns, F.floor(F.col("_position") / size).alias(name))
