"""Task tables: one row for each (key, owner) with its number of values, and what is derived from them."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.functions.text import java_hash
from keyfold.session import ship
from keyfold.sources.readers import numbered

#: Rows of nodes, agents or loads that are broadcast, or gathered in one row; beyond it there are other ways.
MOST_NODES = 10_000


def few(nodes: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """A table of nodes, marked for broadcast if its rows are counted to be few; else Spark joins it by an exchange."""
    return F.broadcast(nodes) if nodes.limit(most + 1).count() <= most else nodes


def _ranked(loads: DataFrame, *fields: Column, most: int = MOST_NODES) -> DataFrame:
    """One row with the sorted array of all nodes' fields: an error if there are too many nodes for one row."""
    if (n := loads.limit(most + 1).count()) > most:
        raise ValueError(f"at least {n} nodes, more than {most} in one row")
    return F.broadcast(loads.groupBy().agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_ranked")))


def chunk(df: DataFrame, key: str, size: int) -> DataFrame:
    """``key, chunk_index, nb_values``: a key's values cut into chunks of at most ``size``.

    Only sizes are asked for, so counting suffices: no key's rows meet in one task.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    index = F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / size).cast("int") - 1))
    return counts.select(key, "_n", index.alias("chunk_index")).select(key, "chunk_index", F.least(F.lit(size), F.col("_n") - F.col("chunk_index") * size).cast("bigint").alias("nb_values"))


def assign_chunks(df: DataFrame, key: str, size: int, *order: str) -> DataFrame:
    """Adds ``chunk_index``: the number (from 0) of the chunk that a row goes to, ``size`` rows of a key to each, in the given order.

    Rows are numbered by ranges of key and order, so a hot key lies in many
    partitions; a row's place in its key is its number less that of the key's
    first row, and only a row for each key and partition is aggregated.
    """
    held = numbered(df, key, *order)
    first = held.groupBy("_block", F.col(key).alias("_k")).agg(F.min("_place").alias("_p"))
    first = first.select("_block", "_k", F.min("_p").over(Window.partitionBy("_k")).alias("_first"))
    placed = held.join(first, (held["_block"] == first["_block"]) & held[key].eqNullSafe(first["_k"]))
    return placed.withColumn("chunk_index", F.floor((F.col("_place") - F.col("_first")) / size).cast("int")).drop("_block", "_place", "_first", "_k")


def replicate(df: DataFrame, factor) -> DataFrame:
    """Every row ``factor`` times (a column or a number), with the copy's number from 1; 0 drops a row."""
    n = factor if not isinstance(factor, int) else F.lit(factor)
    return df.withColumn("copy", F.explode(F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))))


def amplification(key: str, draw: Column, chosen: Sequence[int], classes: int, base: int, start: int, end: int) -> Column:
    """How often a row is to be written: ``base`` times, for chosen keys ``base + start`` and a draw from 0 .. end - start more.

    A key's class is |hash| modulo the classes, and the number of classes in
    place of 0; ``chosen`` lists classes. ``draw`` is a whole number that stands
    for the row's or chunk's random draw, and so gives the same result again.
    """
    kind = F.pmod(F.abs(java_hash(key).cast("long")), F.lit(classes)).cast("int")
    kind = F.when(kind == 0, classes).otherwise(kind)
    return F.when(kind.isin(*chosen), base + start + F.pmod(draw, F.lit(end - start + 1))).otherwise(base).cast("int")


def task_table(df: DataFrame, key: str, owner: str) -> DataFrame:
    """``key, owner, nb_values``."""
    return df.groupBy(F.col(key).alias("key"), F.col(owner).alias("owner")).agg(F.count("*").alias("nb_values"))


def ownership_rate(tasks: DataFrame) -> DataFrame:
    """``key, owner, nb_values, rate``: an owner's share of a task, rounded half up to two places."""
    total = F.sum("nb_values").over(Window.partitionBy("key"))
    return tasks.withColumn("rate", F.round(F.col("nb_values") / total, 2))


def ownership_histogram(rates: DataFrame) -> DataFrame:
    """``rate, n`` for rates 0.0, 0.1 ... 1.0, zero-filled, from a column ``rate``."""
    counted = rates.groupBy(F.round(F.col("rate") * 10).cast("int").alias("tenth")).agg(F.count("*").alias("n"))
    grid = rates.sparkSession.range(11).select(F.col("id").cast("int").alias("tenth"))
    return grid.join(counted, "tenth", "left").select((F.col("tenth") / 10).alias("rate"), F.coalesce("n", F.lit(0)).alias("n"))


# ---- cost models ----


def cost_nb_values(tasks: DataFrame) -> DataFrame:
    """``key, cost``: the number of values."""
    return tasks.groupBy("key").agg(F.sum("nb_values").alias("cost"))


def _per_agent(tasks: DataFrame, agents: DataFrame, local, remote) -> DataFrame:
    """``key, agent, cost`` = sum over owners of the remote cost, corrected for the agent's own part.

    Tasks x agents is the result's own size; (key, owner) rows are not multiplied:
    the all-remote total is computed once a key, and each agent corrects its part.
    """
    totals = tasks.groupBy("key").agg(F.sum(remote).alias("_all"))
    own = tasks.groupBy("key", F.col("owner").alias("agent")).agg(F.sum(local - remote).alias("_own"))
    every = totals.crossJoin(few(agents.select("agent").distinct()))  # tasks x agents: the result's own rows
    return every.join(own, ["key", "agent"], "left").select("key", "agent", (F.col("_all") + F.coalesce("_own", F.lit(0))).alias("cost"))


def cost_remote_multiplier(tasks: DataFrame, agents: DataFrame, multiplier: int) -> DataFrame:
    """Values of other owners count ``multiplier`` times."""
    n = F.col("nb_values")
    return _per_agent(tasks, agents, n, n * multiplier)


def cost_hardware(tasks: DataFrame, agents: DataFrame, latency: int = 1, value_bytes: int = 100, read: int = 50, network: int = 20, values: int = 10) -> DataFrame:
    """Latency, reading, sending (if remote) and processing by rates, in whole numbers; a zero rate disables its term."""
    volume = F.col("nb_values") * value_bytes

    def over(rate: int):
        return F.call_function("div", volume, F.lit(rate).cast("bigint")) if rate else F.lit(0).cast("bigint")

    local = F.lit(latency).cast("bigint") + over(read) + over(values)
    return _per_agent(tasks, agents, local, local + over(network))


# ---- what to run or give away next ----


def bundle_order(tasks: DataFrame) -> DataFrame:
    """``owner, key, cost, place``: an owner's tasks by cost, then key."""
    place = F.row_number().over(Window.partitionBy("owner").orderBy("cost", "key"))
    return tasks.withColumn("place", place)


def next_task(tasks: DataFrame, policy: str = "csdb") -> DataFrame:
    """``owner, perform, delegate``; csdb performs the cheapest and delegates the costliest, cbds the other way round."""
    cheapest, costliest = F.min_by("key", F.struct("cost", "key")), F.max_by("key", F.struct("cost", "key"))
    if policy not in ("csdb", "cbds"):
        raise ValueError(f"unknown bundle policy {policy!r}")
    perform, delegate = (cheapest, costliest) if policy == "csdb" else (costliest, cheapest)
    return tasks.groupBy("owner").agg(perform.alias("perform"), delegate.alias("delegate"))


def acceptance(pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Adds ``benefit`` = (mine - (theirs + cost)) / mine and ``accepts`` = benefit > threshold.

    Columns ``my_load, peer_load, cost``; a load of zero accepts nothing.
    """
    benefit = (F.col("my_load") - (F.col("peer_load") + F.col("cost"))) / F.nullif(F.col("my_load"), F.lit(0))
    return pairs.withColumn("benefit", benefit).withColumn("accepts", F.coalesce(F.col("benefit") > threshold, F.lit(False)))


def select_bidder(bids: DataFrame) -> DataFrame:
    """``key, winner``: the bidder with the smallest load plus cost, ties to the smaller id."""
    return bids.groupBy("key").agg(F.min_by("bidder", F.struct(F.col("load") + F.col("cost"), F.col("bidder"))).alias("winner"))


def k_eligible_delegate(tasks: DataFrame, loads: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """``owner, key, cost, representative, n_peers`` for every owner that can delegate.

    Of an owner's tasks, those that most peers (counted up to k) would accept;
    among them the one that makes max(my load - cost, representative's load +
    cost) smallest; the representative is the most loaded peer that accepts.
    Ties: smaller key; peers: smaller id. A peer accepts by its load alone, so
    the loads are ranked once and no task meets every peer.
    """
    mine = tasks.join(loads.select("owner", F.col("load").alias("my_load")), "owner")
    # a peer accepts iff its load < my_load * (1 - threshold) - cost: one sorted array of loads answers it
    ranked = _ranked(loads, F.col("load"), (-F.col("owner")).alias("minus"))
    mine = mine.crossJoin(ranked).withColumn("_limit", F.col("my_load") * (1 - threshold) - F.col("cost"))
    fits = F.filter("_ranked", lambda p: (p["load"] < F.col("_limit")) & (p["minus"] != -F.col("owner")))
    mine = mine.withColumn("_fits", fits).where(F.size("_fits") > 0)
    mine = mine.withColumns({"n_peers": F.least(F.size("_fits"), F.lit(k)), "representative": -F.element_at("_fits", -1)["minus"], "_load": F.element_at("_fits", -1)["load"]})
    after = F.greatest(F.col("my_load") - F.col("cost"), F.col("_load") + F.col("cost"))
    best = mine.groupBy("owner").agg(F.min_by(F.struct("key", "cost", "representative", "n_peers"), F.struct(-F.col("n_peers"), after, F.col("key"))).alias("b"))
    return best.select("owner", "b.key", "b.cost", "b.representative", "b.n_peers")


def k_eligible(tasks: DataFrame, loads: DataFrame, k: int, perform: str = "small", threshold: float = 0.0) -> DataFrame:
    """``owner, perform, delegate``: the cheapest (``small``) or costliest (``big``) task is performed next, and the
    k-eligible one (null if no peer accepts any) is offered."""
    if perform not in ("small", "big"):
        raise ValueError(f"unknown order {perform!r}")
    by = F.min_by if perform == "small" else F.max_by
    next_ = tasks.groupBy("owner").agg(by("key", F.struct("cost", "key")).alias("perform"))
    offered = k_eligible_delegate(tasks, loads, k, threshold).select("owner", F.col("key").alias("delegate"))
    return next_.join(offered, "owner", "left")


def bid_order(calls: DataFrame) -> DataFrame:
    """``bidder, initiator, load, place``: in which order a bidder answers calls, the most loaded initiator first (ties: smaller id)."""
    place = F.row_number().over(Window.partitionBy("bidder").orderBy(F.desc("load"), "initiator"))
    return calls.select("bidder", "initiator", "load", place.alias("place"))


def ownership_bundle_order(tasks: DataFrame) -> DataFrame:
    """``owner, key, class, perform_place, delegate_place`` from ``owner, key, cost, rate, max_rate``.

    Classes: 0 the owner holds the largest share, 1 it holds some, 2 none.
    Performing: class 0 costliest first, class 1 by rate downwards, class 2
    cheapest first; delegating: the reverse.
    """
    kind = F.when(F.col("rate") == 0, 2).when(F.col("rate") == F.col("max_rate"), 0).otherwise(1)
    ranked = F.when(F.col("class") == 0, -F.col("cost").cast("double")).when(F.col("class") == 1, -F.col("rate")).otherwise(F.col("cost").cast("double"))
    w = Window.partitionBy("owner")
    t = tasks.withColumn("class", kind).withColumn("_r", ranked)
    return t.select("owner", "key", "class", F.row_number().over(w.orderBy("class", "_r", "key")).alias("perform_place"), F.row_number().over(w.orderBy(F.desc("class"), F.desc("_r"), F.desc("key"))).alias("delegate_place"))


# ---- splitting ----


def split_in_two(chunks: DataFrame) -> DataFrame:
    """``key, half, n_chunks, nb_values``: a task's chunks in two halves, the first not smaller."""
    half = F.ntile(2).over(Window.partitionBy("key").orderBy("chunk_index"))
    return chunks.withColumn("half", half).groupBy("key", "half").agg(F.count("*").alias("n_chunks"), F.sum("nb_values").alias("nb_values"))


def k_split_choice(loads: DataFrame, tasks: DataFrame, chunk_size: int) -> DataFrame:
    """``owner, delta, k, result``: into how many parts an owner's costliest task is best split.

    A peer's delta is the owner's load minus its own; those with 2 * chunk_size
    <= delta <= the task's cost count, from the least loaded (k = 1) on. Chosen
    is the smallest load left, own - k * delta / (k + 1), ties to the smaller k.
    """
    costliest = tasks.groupBy("owner").agg(F.max("cost").alias("cost"))
    mine = loads.join(costliest, "owner").crossJoin(_ranked(loads, F.col("load"), F.col("owner")))
    peers = F.filter("_ranked", lambda p: (p["owner"] != F.col("owner")) & (F.col("load") - p["load"] >= 2 * chunk_size) & (F.col("load") - p["load"] <= F.col("cost")))
    allowed = F.transform(peers, lambda p, i: F.struct(F.col("load").alias("own"), (F.col("load") - p["load"]).alias("delta"), (i + 1).alias("k")))
    scored = F.transform(allowed, lambda o: F.struct(F.round(o["own"] - o["k"] * o["delta"] / (o["k"] + 1), 6).alias("result"), o["k"].alias("k"), o["delta"].alias("delta")))
    return mine.withColumn("_best", F.array_min(scored)).where("_best is not null").select("owner", "_best.delta", "_best.k", "_best.result")


def deal_chunks(chunks: DataFrame, choice: DataFrame) -> DataFrame:
    """``key, chunk_index, nb_values, part``: the chunks of split tasks dealt to k parts, and a rest (part k) that stays.

    ``choice``: ``key, delta, k`` of the tasks to split. In the order of
    ``chunk_index`` a chunk goes to the part with the fewest values so far
    (ties: the part that has waited longest), as long as the values dealt stay
    below delta; from the chunk on that would reach it, all stay. A task's
    chunks stream through one worker, which holds the k parts; tasks are split
    side by side.
    """
    ship(chunks.sparkSession)

    def run(source):
        key, parts, dealt, turn, rest = object(), [], 0, 0, False
        for b in source:
            out = []
            for kk, _, n, delta, k in zip(*(c.to_pylist() for c in b.columns)):
                if kk != key:
                    key, parts, dealt, turn, rest = kk, [(0, p, p) for p in range(k)], 0, k, False
                rest = rest or dealt + n >= delta
                if rest:
                    out.append(k)
                    continue
                load, _, p = heapq.heappop(parts)
                heapq.heappush(parts, (load + n, turn, p))
                dealt, turn = dealt + n, turn + 1
                out.append(p)
            yield pa.record_batch([*b.columns[:3], pa.array(out, pa.int32())], names=["key", "chunk_index", "nb_values", "part"])

    held = chunks.select("key", "chunk_index", F.col("nb_values").cast("bigint")).join(choice.select("key", F.col("delta").cast("bigint"), F.col("k").cast("int")), "key")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in held.schema.fields[:3]]).add("part", T.IntegerType())
    return held.repartition("key").sortWithinPartitions("key", "chunk_index").mapInArrow(run, schema)
