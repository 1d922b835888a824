"""Joins to lookup tables, and leaving out what nobody asks for.

Hot keys are left to adaptive execution, which splits them in inner, left, semi and anti joins: both
sides are read from tables or plain scans, so that nothing above the join ties a key to one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup side is broadcast up to these sizes, both measured.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Bits that keys are hashed to when a table is cut down to them, and bits in one row of the bit table.
KEY_BITS = 27
_ROW_BITS = 15


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a (staged) table is small enough to broadcast, by rows and by bytes.

    One combined count over the table; no rows are moved for it.
    """
    seen = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("b"),
    ).first()
    return seen["n"] <= rows and seen["b"] <= size


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join to a table that is usually small and has unique keys.

    Its size is measured: it is broadcast within the bound and joined by a shuffle join beyond it.
    With ``null_safe`` a NULL key meets the NULL key.
    """
    side = F.broadcast(right) if fits_broadcast(right) else right
    if not null_safe:
        return left.join(side, list(on), how)
    renamed = side.select(*[F.col(c).alias(f"_on_{c}" if c in on else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_on_{c}"]) for c in on])
    return left.join(renamed, same, how).drop(*[f"_on_{c}" for c in on])


def mark_needed(table: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Add a boolean: false only for rows whose key is surely not among ``keys``. Moves no rows.

    The keys are hashed into a table of 2 ** 27 bits, 16 MB at the very most however many keys there
    are, which is broadcast. A row may be true by another key of the same bit, so true is no answer.
    """
    def place(side: DataFrame):
        return F.pmod(F.xxhash64(*[side[c] for c in on]), F.lit(1 << KEY_BITS))

    in_row = (1 << _ROW_BITS) - 1
    bits = (
        keys.select(place(keys).alias("_place"))
        .groupBy(F.shiftright("_place", _ROW_BITS).alias("_bits_row"))
        .agg(F.bitmap_construct_agg(F.col("_place").bitwiseAND(in_row)).alias("_bits"))
    )
    placed = table.withColumn("_place", place(table))
    at = F.col("_place").bitwiseAND(in_row)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = placed.join(F.broadcast(bits), F.shiftright("_place", _ROW_BITS) == F.col("_bits_row"), "left")
    bit = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return met.withColumn(name, bit).drop("_place", "_bits_row", "_bits")


def needed_only(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Leave out rows of a wide table whose key nobody asks for, without shuffling the table.

    Done below any work on the wide columns: most of the table is then neither hashed nor moved. Some
    rows that nobody asks for may stay, so the join that follows decides; none that it needs is left out.
    """
    return mark_needed(table, keys, on, "_needed").filter("_needed").drop("_needed")
