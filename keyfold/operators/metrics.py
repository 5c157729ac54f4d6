"""Run metrics: fairness, profiles, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(x, places: int = 6) -> Column:
    """Smallest over largest."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(F.min(x) / F.max(x), places)


def better_by(a: Column, c: Column, places: int = 6) -> Column:
    """By how many per cent a's largest value is below c's."""
    return F.round(100 - a / c * 100, places)


def profile(chunks: DataFrame, n: str = "n") -> DataFrame:
    """``tasks, most, mean, median, singletons`` of a table with one row for each task.

    The median is element n div 2 of the sorted sizes, read from their histogram,
    whose rows are the distinct sizes; the mean is in whole numbers.
    """
    sizes = chunks.groupBy(n).agg(F.count("*").alias("_c"))
    folded = sizes.agg(F.sum("_c").alias("tasks"), F.max(n).alias("most"), F.sum(F.col(n) * F.col("_c")).alias("_s"), F.sort_array(F.collect_list(F.struct(F.col(n).alias("v"), F.col("_c").alias("c")))).alias("_h"), F.coalesce(F.sum(F.when(F.col(n) == 1, F.col("_c"))), F.lit(0)).alias("singletons"))
    at = F.aggregate("_h", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("m")), lambda a, h: F.struct((a["seen"] + h["c"]).alias("seen"), F.when(a["m"].isNull() & (a["seen"] + h["c"] > F.call_function("div", F.col("tasks"), F.lit(2).cast("bigint"))), h["v"]).otherwise(a["m"]).alias("m")))
    return folded.select("tasks", "most", F.call_function("div", F.col("_s"), F.col("tasks")).alias("mean"), at["m"].alias("median"), "singletons")


def same_results(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks: ``keys, left_value, right_value``."""
    left, right = a.select(*keys, F.col(value).alias("left_value")), b.select(*keys, F.col(value).alias("right_value"))
    return left.join(right, list(keys), "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


#: Outcomes of calls for proposals, and the proposals received, in the order in which they are reported.
NEGOTIATION = ("initiated", "canceled", "denied", "declined_by_all", "successful", "proposals")


def negotiation_totals(log: DataFrame) -> DataFrame:
    """One row: how often each outcome of NEGOTIATION occurs in a log's column ``outcome``."""
    return log.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in NEGOTIATION])


def initial_workloads(archive: DataFrame) -> DataFrame:
    """``id, workload``: each receiver's first value in an archive of ``id, ts, value, seq``."""
    return archive.groupBy("id").agg(F.min_by("value", F.struct("ts", "seq")).alias("workload"))
