"""Connected components on DataFrames by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, Scratch, join_hot


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, comp`` (comp: the smallest node reachable) for every node of ``edges`` (longs a, b).

    Each round links all larger neighbours of a node to the smallest one, then
    all smaller ones; the rounds grow with the logarithm of the longest path.
    Every round is written to the shared folder. No row leaves the executors,
    but for nodes of very many edges, which are broadcast (``join_hot``).
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _least(both, 2 * mark[0], scratch)
        large = scratch.save(join_hot(both, low, "a", "n", 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        low2 = _least(large, 2 * mark[0], scratch)
        small = join_hot(large, low2, "a", "n", 2 * mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low2.select("a", F.col("m").alias("b")))
        small = scratch.save(small.distinct())
        scratch.drop(now, large, low, low2)
        now, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _least(edges: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """``a, m, n``: of each node the smallest neighbour and the number of its edges."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return scratch.save(low) if total > HOT_ROWS else low


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of the edge set: it stays when a round changes nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
