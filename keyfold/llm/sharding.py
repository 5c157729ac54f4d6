"""Sharding by a hypergeometric communication matrix (DataFrame operations only).

A uniform shuffle with exact shard sizes: rows lie in the partitions in which
they are read; the numbers of rows that each partition sends to each shard are
drawn from the multivariate hypergeometric law that a uniform permutation would
give; every partition permutes its rows where they are and deals them by those
numbers; after the exchange every shard permutes what it has received.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a bucket in which a shard's rows are put in order.
ROWS = 20_000
#: Bound on the partitions, and so on the matrix that the driver draws and broadcasts (16 shards: 2 MB).
PARTITIONS = 16_384


def shard_sizes(total: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones ``draws`` draws without replacement have (inversion from the mode)."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - p
    if u <= 0:
        return mode
    up, p_up, down, p_down = mode, p, mode, p
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows: partitions; columns: shards; both margins are exact."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, draws, pool = [], n, sum(left)
        for s, free in enumerate(left):
            pool -= free
            k = _hypergeometric(rng, free, pool, draws)
            row.append(k)
            draws -= k
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def shuffle_shards(docs: DataFrame, shards: int = 16, seed: int = 7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Puts every row into one of ``shards`` shards: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``rows``: shard sizes differ by one at most; ``slot`` is gapless from 0.
    Null text counts no bytes (size 1, crc32 of the empty text). Null keys,
    ties and repeated rows are rows like others: each gets its own slot. An
    empty table gives an empty result. Other columns are ignored.
    The place of a row is drawn once, with the row's random key, into a written
    table; a lost task reads it again, so slots never repeat. A partition's rows
    are permuted by a sort inside it, without an exchange; beyond PARTITIONS
    partitions, neighbours are read together.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_n"))
    # _n tells repeated rows apart; the draws hang on what is written here, once
    slim = slim.coalesce(PARTITIONS).withColumn("_deal", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "_n"))
    # first permutation, local: the id counts a partition's rows in the order of their random keys
    slim = slim.sortWithinPartitions("_deal", "_n").withColumn("_id", F.monotonically_increasing_id())
    slim = scratch.save(slim.select("doc_id", "size", "text_crc32", "_deal", "_n", F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_rank")))
    counts = sorted(slim.groupBy("_part").count().collect())  # PARTITIONS rows at most
    total = sum(n for _, n in counts)
    if not total:
        return slim.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    matrix = communication_matrix([n for _, n in counts], shard_sizes(total, shards), seed)
    upto = spark.createDataFrame([(p, [sum(row[: s + 1]) for s in range(shards)]) for (p, _), row in zip(counts, matrix)], "_part int, _upto array<long>")
    # dealt by the matrix row
    dealt = slim.join(F.broadcast(upto), "_part").withColumn("shard", F.size(F.filter("_upto", lambda x: x <= F.col("_rank"))).cast("int"))
    # second permutation: a random order of each shard, by buckets of bounded size
    n_buckets = max(1, total // shards // ROWS)
    dealt = dealt.withColumn("_order", F.xxhash64(F.lit(seed + 2), "_deal", "_n")).withColumn("_bucket", F.pmod("_order", F.lit(n_buckets)).cast("int"))
    dealt = scratch.save(dealt.select("doc_id", "size", "text_crc32", "shard", "_order", "_bucket", "_deal", "_n"))
    sizes = dealt.groupBy("shard", "_bucket").count()
    starts = sizes.withColumn("_start", F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("count")).drop("count")
    ordered = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_order", "_deal", "_n")) - 1)
    return ordered.join(starts, ["shard", "_bucket"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_start") + F.col("_place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
