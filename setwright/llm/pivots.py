"""Exact top-k search by inner product, with a table of distances to pivots.

Components are scaled and floored to integers, so scores are exact. ``PIVOTS`` vectors, spread far apart, are taken from a
bounded sample, and every vector's distance to every pivot is stored beside it: the pivot table. For a
query ``q`` and a vector ``x`` each pivot gives ``|d(q, p) - d(x, p)| <= d(q, x)``; the largest of these bounds the
score from above, since ``2 q.x = |q|^2 + |x|^2 - d(q, x)^2``. Candidates are evaluated in the order of that bound, until
the next bound is below the k-th best score found.

Vectors lie in the cell of their nearest pivot; a cell is dealt into blocks of at most about ``BLOCK_ROWS`` rows by
hash, so one cell, or copies of one vector, may hold most rows. A query first meets the block it lies in, which gives its first
threshold. Then it is sent to those blocks only whose range of pivot distances allows a score of that height; the ranges
are one row per cell. A task holds the vectors of one block and streams the queries that were
sent there, so its memory does not follow the number of queries. Nothing is approximate: the sample only says where the pivots are,
and bounds have a margin above their rounding errors.

Defined results: null vectors, vectors with a null or non-finite component, and vectors whose squared length reaches 2^62 (whose
scores may not fit a long) take no part; components past a vector's end count as 0; the empty vector scores 0
with all. Equal scores go to the smaller id, a null id last. Rows that repeat an id are each a query and a
candidate of their own, and a row is never its own candidate. A table without queries gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setwright.llm.textarrays import small_batches
from setwright.session import staged

PIVOTS = 32
#: Vectors among which the pivots are looked for.
SAMPLE_ROWS = 1000
BLOCK_ROWS = 16_384
#: Components that a block holds, where vectors are long.
BLOCK_VALUES = 1 << 22
#: Bounds evaluated at a time before the threshold is looked at again.
_FIRST = 64
#: Queries whose bounds are computed together.
_TILE = 64
#: Above the rounding errors of bounds in single precision.
_SLACK = 4e-6
_EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, uid, v, sq``: the rows that take part, numbered, with integer components and squared length."""
    x = F.col("_x").cast("array<double>")
    bad = F.exists("_x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(vectors[key].alias("id"), vectors[vector].alias("_x")).filter("_x IS NOT NULL").select("id", x.alias("_x")).filter(~bad)
    whole = rows.select("id", F.transform("_x", lambda c: F.floor(scale * c)).alias("v"))
    sized = whole.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return staged(sized.filter(F.col("sq") < 2.0**62).withColumn("uid", F.monotonically_increasing_id()), "integer_vectors")


def matrix(lists: pa.Array, width: int, kind) -> np.ndarray:
    """A list column as rows of ``width`` values, padded with 0."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(kind)
    if len(lists) and (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), kind)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before it."""
    chosen = sample[:1]
    far = ((sample - sample[:1]) ** 2).sum(axis=1) if len(sample) else np.empty(0)
    while len(chosen) < count and far.size and far.max() > 0:
        chosen = np.vstack([chosen, sample[far.argmax()]])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return chosen


def pivot_table(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """``rows`` with ``cell``, the nearest pivot, and ``d``, the distance to each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), width, np.float64)
            # Differences, not products, so that small distances keep their digits.
            d = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            bounds = np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)
            columns = [*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(d.ravel().astype(np.float32)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cell", "d"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return staged(rows.mapInArrow(run, f"{kind}, cell int, d array<float>"), "pivot_table")


class Block:
    """The vectors of one block, and the evaluation of queries against them."""

    def __init__(self, rows: pa.Table, width: int):
        rows = rows.combine_chunks()
        self.uid = rows.column("uid").to_numpy()
        ids = rows.column("id").combine_chunks()
        # Equal scores go to the smaller id; nulls come last.
        order = pc.sort_indices(pa.table({"id": ids, "uid": self.uid}), sort_keys=[("id", "ascending"), ("uid", "ascending")], null_placement="at_end")
        rows = rows.take(order)
        self.uid, self.ids = rows.column("uid").to_numpy(), rows.column("id").combine_chunks()
        self.whole = matrix(rows.column("v").combine_chunks(), width, np.int64)
        self.near = self.whole.astype(np.float64)
        self.sq = rows.column("sq").to_numpy()
        self.d = matrix(rows.column("d").combine_chunks(), len(rows.column("d")[0]), np.float32).T.copy()

    def scores(self, query: np.ndarray, sq: float, at: np.ndarray | slice) -> np.ndarray:
        """Exact inner products; all partial sums are whole numbers below the product of the lengths."""
        exact = np.sqrt(sq * (self.sq.max() if len(self.sq) else 0.0)) * 1.001 + 1 < _EXACT
        return (self.near[at] @ query.astype(np.float64)).astype(np.int64) if exact else self.whole[at] @ query

    def bounds(self, d: np.ndarray, sq: np.ndarray) -> np.ndarray:
        """For each query (rows) no score less than this for each vector (columns)."""
        low = np.zeros((len(d), len(self.uid)), np.float32)
        gap = np.empty_like(low)
        for p in range(d.shape[1]):
            np.subtract(d[:, p, None], self.d[p][None, :], out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        low = np.maximum(low.astype(np.float64) - _SLACK * (1 + max(d.max(initial=0), self.d.max(initial=0))), 0)
        both = sq[:, None] + self.sq[None, :]
        return (both * (1 + 1e-9) - low * low) / 2 + 1

    def best(self, uid: int, query: np.ndarray, sq: float, bound: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best vectors, in bound order up to where no bound reaches the k-th score.

        ``least`` is a score that the ``k`` best of the whole table reach for sure.
        """
        places, found = np.empty(0, np.int64), np.empty(0, np.int64)
        left, size = np.flatnonzero((bound >= least) & (self.uid != uid)), _FIRST
        while len(left):
            if size < len(left):
                first = np.argpartition(-bound[left], size - 1)
                now, left = left[first[:size]], left[first[size:]]
            else:
                now, left = left, left[:0]
            places, found = np.concatenate([places, now]), np.concatenate([found, self.scores(query, sq, now)])
            if len(found) > k:
                edge = np.partition(found, len(found) - k)[len(found) - k]
                tied = found >= edge
                places, found = places[tied], found[tied]
                order = np.lexsort((places, -found))[:k]
                places, found = places[order], found[order]
            if len(found) == k:
                least = max(least, float(found.min()))
                left = left[bound[left] >= least]
            size *= 8
        return places, found


def _evaluated(table: DataFrame, sent: DataFrame, width: int, k: int) -> DataFrame:
    """``query, uid, id, score`` of the best ``k`` of each block for the queries sent there."""
    kind = table.schema["id"].dataType.simpleString()
    columns = ["block", "asks", "uid", "id", "v", "sq", "d", "least"]
    vectors = table.select("block", F.lit(False).alias("asks"), "uid", "id", "v", "sq", "d", F.lit(None).cast("double").alias("least"))
    queries = sent.select("block", F.lit(True).alias("asks"), "uid", "id", "v", "sq", "d", "least")
    # Vectors of a block come before the queries sent there.
    dealt = vectors.unionByName(queries).repartition("block").sortWithinPartitions("block", "asks")

    def answers(block: Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q, sq = matrix(part.column("v"), width, np.int64), part.column("sq").to_numpy()
        d = matrix(part.column("d"), len(block.d), np.float32)
        least = part.column("least").fill_null(-np.inf).to_numpy()
        uids = part.column("uid").to_numpy()
        for a in range(0, part.num_rows, _TILE):
            bounds = block.bounds(d[a : a + _TILE], sq[a : a + _TILE])
            got = [block.best(uids[a + i], q[a + i], sq[a + i], bounds[i], k, least[a + i]) for i in range(len(bounds))]
            places = np.concatenate([g[0] for g in got]).astype(np.int64)
            asked = np.repeat(uids[a : a + _TILE], [len(g[0]) for g in got])
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked), pa.array(block.uid[places]), block.ids.take(pa.array(places)), pa.array(np.concatenate([g[1] for g in got]).astype(np.int64))],
                names=["query", "uid", "id", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if blocks[a] != number:
                    number, held, block = blocks[a], [], None
                if not asks[a]:
                    held.append(part)
                else:
                    if block is None:
                        block, held = Block(pa.Table.from_batches(held), width), []
                    yield from answers(block, part)

    return small_batches(dealt.select(*columns)).mapInArrow(run, f"query bigint, uid bigint, id {kind}, score bigint")


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, <key>, score``: the ``k`` highest inner products of each row whose key ``every`` divides, with all other rows."""
    rows = integer_vectors(vectors, key, vector, scale)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    sample = rows.select("v").orderBy(F.xxhash64("v"), "uid").limit(SAMPLE_ROWS).collect()
    points = np.zeros((max(1, len(sample)), width))
    for i, (v,) in enumerate(sample):
        points[i, : len(v)] = v
    chosen = spread(points, pivots)
    table = pivot_table(small_batches(rows), chosen, width)

    # One row per pivot.
    ranges = [F.min(F.get("d", p)).alias(f"low{p}") for p in range(len(chosen))] + [F.max(F.get("d", p)).alias(f"high{p}") for p in range(len(chosen))]
    cells = sorted(table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("sq").alias("sq"), *ranges).collect())
    size = max(1, min(block_rows, BLOCK_VALUES // max(1, width)))
    counts = {c["cell"]: -(-c["n"] // size) for c in cells}
    first, total = {}, 0
    for c, n in counts.items():
        first[c], total = total, total + n
    entry = lambda of: F.element_at(F.create_map(*[F.lit(x) for c in of for x in (c, of[c])]), F.col("cell")) if of else F.lit(0)
    placed = staged(table.withColumn("block", (entry(first) + F.pmod(F.xxhash64("uid"), entry(counts))).cast("bigint")), "blocks")
    asked = placed.filter(F.col("id") % every == 0).withColumn("least", F.lit(None).cast("double"))

    home = staged(_evaluated(placed, asked, width, k), "home")
    reached = home.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    known = asked.drop("least").join(reached.select(F.col("query").alias("uid"), F.col("least").cast("double").alias("least")), "uid", "left")
    low = np.array([[c[f"low{p}"] for p in range(len(chosen))] for c in cells], np.float64)
    high = np.array([[c[f"high{p}"] for p in range(len(chosen))] for c in cells], np.float64)
    longest = np.array([c["sq"] for c in cells])
    starts, numbers = np.array(list(first.values())), np.array(list(counts.values()))

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the numbers of the blocks, but its own, in which a vector may reach its threshold."""
        for batch in batches:
            d = matrix(batch.column("d"), low.shape[1], np.float64)
            sq, least = batch.column("sq").to_numpy(), batch.column("least").fill_null(-np.inf).to_numpy()
            own = batch.column("block").to_numpy()
            blocks = []
            for i in range(batch.num_rows):
                gap = np.maximum(np.maximum(d[i] - high, low - d[i]), 0).max(axis=1)
                gap = np.maximum(gap - _SLACK * (1 + max(d[i].max(initial=0), high.max(initial=0))), 0)
                go = ((sq[i] + longest) * (1 + 1e-9) - gap * gap) / 2 + 1 >= least[i]
                each = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[go], numbers[go])] or [starts[:0]])
                blocks.append(each[each != own[i]])
            bounds = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int32)
            flat = np.concatenate(blocks).astype(np.int64) if blocks else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("least"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=["uid", "least", "to"])

    to = known.select("uid", "sq", "d", "block", "least").mapInArrow(routes, "uid bigint, least double, to array<bigint>")
    sent = asked.select("uid", "id", "v", "sq", "d").join(to, "uid").select("uid", "id", "v", "sq", "d", "least", F.explode("to").alias("block"))
    away = _evaluated(placed, sent, width, k)

    each = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    best = home.unionByName(away).withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= k)
    names = asked.select(F.col("uid").alias("query"), F.col("id").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", F.col("id").alias(key), "score")
