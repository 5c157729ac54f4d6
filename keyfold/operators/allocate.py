"""Initial allocation of tasks to receivers, and rounds of delegation.

Allocators that look at the loads so far go through the tasks one by one. They
read the task table (a row for each key, not for each record), sorted by Spark,
as a stream on one worker with a heap of receivers: memory holds the receivers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions.text import hash_bucket
from keyfold.session import scratch_path, ship


def _stream(df: DataFrame, run, ddl: str, *order, blocks: int = 1) -> DataFrame:
    ship(df.sparkSession)
    dealt = df.repartition(1) if blocks == 1 else df.repartition(blocks, F.xxhash64("key"))
    return dealt.sortWithinPartitions(*order).mapInArrow(run, ddl)


def _emit(b: pa.RecordBatch, receivers: list[int]) -> pa.RecordBatch:
    return pa.record_batch([b.column(0), pa.array(receivers, pa.int32()), b.column(1)], names=["key", "receiver", "cost"])


def lpt(tasks: DataFrame, receivers: int, blocks: int = 1) -> DataFrame:
    """``key, receiver, cost``: longest first, each to the least loaded receiver (ties: lowest number, then key).

    The greedy rule looks at all loads so far, so one worker streams the task
    table. For very many keys ``blocks`` > 1 deals the tasks by hash to blocks
    that are allocated side by side: in each block loads differ by one task's
    cost at most, so over all by at most the blocks' largest costs together.
    """
    kind = tasks.schema["key"].dataType.simpleString()

    def run(source) -> Iterator[pa.RecordBatch]:
        heap = [(0, i) for i in range(receivers)]
        for b in source:
            out = []
            for cost in b.column(1).to_pylist():
                load, i = heapq.heappop(heap)
                heapq.heappush(heap, (load + cost, i))
                out.append(i)
            yield _emit(b, out)

    return _stream(tasks.select("key", F.col("cost").cast("bigint")), run, f"key {kind}, receiver int, cost bigint", F.desc("cost"), "key", blocks=blocks)


def by_hash(tasks: DataFrame, receivers: int) -> DataFrame:
    """``key, receiver, cost``: by the key's string hash; no task depends on another."""
    return tasks.withColumn("_k", F.col("key").cast("string")).select("key", hash_bucket("_k", receivers).alias("receiver"), "cost")


def by_ownership(tasks: DataFrame, receivers: int) -> DataFrame:
    """``key, receiver, cost`` from ``key, cost, best_owners`` (owners with the largest share).

    Tasks with a receiver among those go, in key order, to the least loaded of
    them; the rest, in key order, to the least loaded receiver of all.
    """
    kind = tasks.schema["key"].dataType.simpleString()

    def run(source) -> Iterator[pa.RecordBatch]:
        loads = [0] * receivers
        for b in source:
            out = []
            for cost, near in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                i = min(near or range(receivers), key=lambda r: (loads[r], r))
                loads[i] += cost
                out.append(i)
            yield _emit(b, out)

    near = F.filter(F.col("best_owners").cast("array<int>"), lambda o: (o >= 0) & (o < receivers))
    t = tasks.select("key", F.col("cost").cast("bigint").alias("cost"), near.alias("near"))
    return _stream(t, run, f"key {kind}, receiver int, cost bigint", F.size("near") == 0, "key")


def by_key_suffix(tasks: DataFrame, receivers: int) -> DataFrame:
    """``key, receiver, cost`` for keys ``a_b``: receiver b modulo the receivers; the key becomes a."""
    return tasks.select(F.split_part("key", F.lit("_"), F.lit(1)).alias("key"), F.pmod(F.split_part("key", F.lit("_"), F.lit(2)).cast("int"), F.lit(receivers)).alias("receiver"), "cost")


def loads_of(allocation: DataFrame) -> DataFrame:
    """``receiver, load``."""
    return allocation.groupBy("receiver").agg(F.sum("cost").alias("load"))


def apply(df: DataFrame, allocation: DataFrame, key: str, receivers: int) -> DataFrame:
    """Rows of df in the partitions that the allocation says."""
    placed = df.join(allocation.select(F.col("key").alias(key), "receiver"), key)
    return placed.repartitionById(receivers, "receiver")


def delegation_rounds(allocation: DataFrame, receivers: int, rounds: int | None = None, threshold: float = 0.0) -> DataFrame:
    """``key, receiver, cost`` after rounds of delegation between the most and least loaded receivers.

    A round ranks receivers by load; each of the first half offers tasks to the
    receiver at the mirrored rank, the costliest that this accepts first: the
    taker's load plus the cost stays below the giver's load by more than the
    threshold. It goes on with the next costliest while each is accepted after
    those before. No load ever passes the largest before, and no task is lost.
    Rounds end when nothing moves, or at a bound if one is given; each is
    written to the shared folder.
    """
    spark = allocation.sparkSession
    now = allocation.select("key", "receiver", "cost")
    path, done = scratch_path(spark, "delegation"), 0

    def save(df: DataFrame) -> DataFrame:
        to = f"{path}/{done}"
        df.write.parquet(to)
        return spark.read.schema(df.schema).parquet(to)

    now = save(now)
    while rounds is None or done < rounds:
        loads = {r["receiver"]: r["load"] for r in loads_of(now).collect()}  # receivers: nodes of a cluster
        ranked = sorted(range(receivers), key=lambda r: (-loads.get(r, 0), r))
        pairs = [(g, t, loads.get(g, 0), loads.get(t, 0)) for g, t in zip(ranked[: receivers // 2], reversed(ranked)) if loads.get(g, 0) > loads.get(t, 0)]
        if not pairs:
            break
        peers = spark.createDataFrame(pairs, "receiver int, taker int, mine bigint, theirs bigint")
        fits = now.join(F.broadcast(peers), "receiver").where((F.col("mine") - (F.col("theirs") + F.col("cost"))) / F.col("mine") > threshold)
        # costliest first; a task without a cost moves nothing
        first = Window.partitionBy("receiver").orderBy(F.desc("cost"), F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        after = F.sum("cost").over(first)
        left = F.col("mine") - (F.col("_after") - F.col("cost"))
        fits = fits.where("cost > 0 and key is not null").withColumn("_after", after).withColumn("_takes", (left - (F.col("theirs") + F.col("_after"))) / left > threshold)
        moved = fits.withColumn("_all", F.min("_takes").over(first)).where("_all").select("key", "receiver", "taker")
        if moved.isEmpty():
            break
        done += 1
        now = save(now.join(moved, ["key", "receiver"], "left").select("key", F.coalesce("taker", "receiver").alias("receiver"), "cost"))
    return now


def place_in_window(df: DataFrame, by: str, *order) -> DataFrame:
    """A row's place (from 0) among those of equal ``by``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
