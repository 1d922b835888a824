"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setwright.session import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node reachable from each node of an undirected edge table.

    Returns ``node, component``, one row per node that has an edge. Alternates two steps until
    nothing changes: every node hands its larger neighbours to its smallest one (large star), then its
    smaller neighbours (small star). The number of edges never grows, and a path of n nodes takes about
    log n rounds. Minima are combined before the shuffle; joins are plain equi-joins, which
    adaptive execution splits where one node has most edges. Each round is a table in the
    shared folder, so a lost executor repeats one round at most. Edges with a null end and self-loops are
    left out; an empty table has no components.
    """
    pairs = staged(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                pairs.select(F.col("b"), F.col("b")).distinct()
            )
        before = state
        pairs = staged(_small_star(staged(_large_star(pairs), "large_star")), "small_star")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Tie each node's larger neighbours to the smallest of the node and its neighbours."""
    # Every edge has a > b: of a node's neighbours, the smaller are its b and the larger its a.
    least = pairs.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("least"))
    joined = pairs.join(least, pairs["b"] == least["n"], "left")
    return joined.select("a", F.coalesce("least", "b").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of those."""
    least = pairs.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("least"))
    joined = pairs.join(least, pairs["a"] == least["n"])
    moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a != b")
    return moved.union(joined.select("a", F.col("least").alias("b"))).distinct()
